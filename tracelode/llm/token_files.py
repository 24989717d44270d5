"""Token ids as length-delimited binary records with masked checksums and an offset index.

A shard holds records back to back; a record is

    u64 length | u32 masked crc of those 8 bytes | payload | u32 masked crc of the payload

with everything little-endian, the payload the ids of one sequence as u16 (vocabularies up to 65,536) or u32, and
the mask that of the common record format, ((crc >> 15 | crc << 17) + 0xa282ead8) mod 2^32, over CRC-32 (zlib).
Beside shard ``x.tok`` lies its index ``x.idx``: per record the key (i64), the byte offset (u64) and the number
of ids (u32), after a header (magic, width, count), so that a reader can shuffle records without reading the data.

Writing: rows are range-partitioned by key on bounds that come from the keys alone, sorted, and each task writes
one shard under a temporary name that it renames when complete, so a repeated task replaces its own file only.
Shards ascend by key. Files go through Arrow's file systems to a folder that all executors share.

Defined cases: null or empty texts are records of the end id alone; null keys come first (stored as the least
i64); rows with equal keys stay as they are, ordered by text; added tokens that a text spells out become their ids, as the
library does; empty tables give no shard and no rows.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.common import broadcast_value, shared_path, slices

MAGIC = b"TOKIDX01"
HEADER = "<8sIIQ"
ENTRY = np.dtype([("key", "<i8"), ("offset", "<u8"), ("n", "<u4")])
CACHE = 250_000
#: Any other text is cut here for the word cache; no pre-token of a tokenizer with SPLIT reaches across white space.
ASCII_SPACE = bytes(32 if b in b" \t\n\r\x0b\x0c" else b for b in range(256))


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(zlib.crc32(size))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


class BrokenRecord(ValueError):
    pass


def unframe(data: memoryview, offset: int) -> tuple[memoryview, int]:
    """(payload, offset of the next record); raises BrokenRecord if a checksum or the length does not fit."""
    head = bytes(data[offset : offset + 12])
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(zlib.crc32(head[:8])):
        raise BrokenRecord(f"length at {offset}")
    end = offset + 12 + struct.unpack("<Q", head[:8])[0]
    payload = data[offset + 12 : end]
    tail = bytes(data[end : end + 4])
    if len(tail) < 4 or struct.unpack("<I", tail)[0] != masked(zlib.crc32(payload)):
        raise BrokenRecord(f"payload at {offset}")
    return payload, end + 4


def _letters_below(limit: int, kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(limit) if unicodedata.category(chr(c))[0] == kind)


#: Below this code point every text is its own NFC form and lower-cases character by character.
PLAIN = 0x250
BEYOND = re.compile(f"[^\\x00-{chr(PLAIN - 1)}]")
_L, _N, _S = _letters_below(PLAIN, "L"), _letters_below(PLAIN, "N"), r"\t\n\x0b\x0c\r \x85\xa0"
#: What a tokenizer file says of its text rules where the word cache applies (fixed values of that format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
#: SPLIT over plain text.
PRE_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def _byte_alphabet() -> list[str]:
    """The visible character of each byte in byte-level vocabularies: printable ones as they are, others from 256 up."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WordCache(dict):
    """Pre-token (str, plain and in lower case) or white-space-delimited piece (bytes) -> ids as bytes.

    A pre-token that is not known goes to the tokenizer's merges, a piece of any other text to the whole tokenizer.
    Texts with an added token, and all texts where the file's rules are not RULES, go to the whole tokenizer as they are.
    """

    def __init__(self, definition: str, dtype: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.dtype = Tokenizer.from_str(definition), dtype
        self.merge, self.alphabet = self.tokenizer.model.tokenize, _byte_alphabet()
        rules = json.loads(definition)
        self.by_words = rules["model"]["type"] == "BPE" and not rules["model"].get("dropout") and all(rules.get(k) == v for k, v in RULES.items())
        added = {t["content"].lower() for t in rules.get("added_tokens", ())}
        self.added = re.compile("|".join(map(re.escape, sorted(added)))) if added else None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def __missing__(self, word: str | bytes) -> bytes:
        if isinstance(word, str):
            alphabet = self.alphabet
            ids = np.array([x.id for x in self.merge("".join([alphabet[b] for b in word.encode()]))], dtype=self.dtype).tobytes()
        else:
            ids = self.whole(word.decode())
        if len(word) <= 64:
            if len(self) > CACHE:
                for old in list(islice(self, CACHE // 2)):
                    del self[old]
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        low = text.lower()
        if not self.by_words or (self.added and self.added.search(low)):
            return self.whole(text)
        if BEYOND.search(text) or BEYOND.search(low):
            return b"".join(map(self.__getitem__, text.encode().translate(ASCII_SPACE).split(b" ")))
        return b"".join(map(self.__getitem__, PRE_TOKENS.findall(low)))


_CACHES: dict[str, WordCache] = {}


def cache_of(definition: str, dtype: str) -> WordCache:
    """The cache of a tokenizer, kept for later tasks of the same Python process."""
    if definition not in _CACHES:
        _CACHES.clear()
        _CACHES[definition] = WordCache(definition, dtype)
    return _CACHES[definition]


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    return fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 2, key: str = "doc_id", text: str = "text", shard_rows: int = 50_000) -> DataFrame:
    """Writes shards under out; returns (shard, path, n_records, n_tokens), one row a shard, in ascending key order."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    vocabulary = Tokenizer.from_str(definition).get_vocab_size()
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    shared = broadcast_value(spark, definition, 64 << 20, len(definition.encode()), "tokenizer definition")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.count()
    n = max(1, min(-(-total // shard_rows), 100_000)) if total else 1
    n = max(n, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, total // 500)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = context.partitionId()
        system, folder = _file_system(out)
        cache = cache_of(shared.value, dtype)
        end = np.array([end_id], dtype=dtype).tobytes()
        width = len(end)
        name = f"{folder}/shard-{shard:06d}"
        attempt = f".{context.taskAttemptId()}.tmp"
        entries, offset, sink = [], 0, None
        for b in slices(batches):
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if sink is None:
                    system.create_dir(folder, recursive=True)
                    sink = system.open_output_stream(f"{name}.tok{attempt}")
                payload = cache.encode(t) + end
                sink.write(frame(payload))
                entries.append((-(1 << 63) if k is None else k, offset, len(payload) // width))
                offset += len(payload) + 16
        if sink is None:
            return
        sink.close()
        table = np.array(entries, dtype=ENTRY)
        with system.open_output_stream(f"{name}.idx{attempt}") as f:
            f.write(struct.pack(HEADER, MAGIC, width, 0, len(table)) + table.tobytes())
        for kind in ("tok", "idx"):
            system.move(f"{name}.{kind}{attempt}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{out}/shard-{shard:06d}"], "n_records": pa.array([len(table)], pa.int64()), "n_tokens": pa.array([int(table["n"].sum())], pa.int64())})

    ranged = rows.repartitionByRange(n, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    done = ranged.mapInArrow(run, "shard int, path string, n_records long, n_tokens long").collect()  # one row a shard
    return spark.createDataFrame(sorted(map(tuple, done)), "shard int, path string, n_records long, n_tokens long")


def read_index(path: str) -> tuple[np.ndarray, int]:
    """(key, offset, n) of each record of the shard, and the bytes an id takes."""
    system, name = _file_system(f"{path}.idx")
    with system.open_input_stream(name) as f:
        data = f.read()
    magic, width, _, count = struct.unpack_from(HEADER, data)
    if magic != MAGIC or len(data) != struct.calcsize(HEADER) + count * ENTRY.itemsize:
        raise BrokenRecord(f"index {path}")
    return np.frombuffer(data, ENTRY, count, struct.calcsize(HEADER)), width


def read_record(path: str, offset: int, width: int) -> np.ndarray:
    """The ids of the record at offset, without reading the rest of the shard."""
    system, name = _file_system(f"{path}.tok")
    with system.open_input_file(name) as f:
        head = f.read_at(12, offset)
        size = struct.unpack("<Q", head[:8])[0]
        payload, _ = unframe(memoryview(f.read_at(size + 16, offset)), 0)
    return np.frombuffer(payload, f"<u{width}").astype(np.uint32)


def read_tokens(shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids) of every record; start counts the ids of all records before it."""
    spark = shards.sparkSession
    listed = sorted(map(tuple, shards.select("shard", "path", "n_records", "n_tokens").collect()))  # one row a shard
    starts, before = [], 0
    for shard, path, _, n in listed:
        starts.append((shard, path, before))
        before += n
    frame_of = spark.createDataFrame(starts, "shard int, path string, before long").repartition(max(1, len(starts)), "shard")
    schema = "key long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        for b in batches:
            for path, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                index, width = read_index(path)
                system, name = _file_system(f"{path}.tok")
                with system.open_input_file(name) as f:
                    bound = f.size()
                    for lo in range(0, len(index), 4096):
                        part = index[lo : lo + 4096]
                        first = int(part["offset"][0])
                        last = int(index["offset"][lo + 4096]) if lo + 4096 < len(index) else bound
                        data = memoryview(f.read_at(last - first, first))
                        crcs, ids, offset = [], [], 0
                        for n in part["n"].tolist():
                            payload, offset = unframe(data, offset)
                            got = np.frombuffer(payload, f"<u{width}").astype("<u4")
                            if len(got) != n:
                                raise BrokenRecord(f"{path}: index and record differ")
                            crcs.append(zlib.crc32(got.tobytes()))
                            if with_ids:
                                ids.append(got.astype(np.int32))
                        n = part["n"].astype(np.int64)
                        start = at + np.cumsum(n) - n
                        at += int(n.sum())
                        keys = pa.array(part["key"], mask=part["key"] == -(1 << 63))
                        cols = {"key": keys, "start": pa.array(start), "n_tokens": pa.array(n), "ids_crc32": pa.array(crcs, pa.int64())}
                        if with_ids:
                            cols["ids"] = pa.array(ids, pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_pydict(cols)

    return frame_of.mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    shards = write_tokens(docs, default_tokenizer(), shared_path(spark, "tokens"))
    return read_tokens(shards, with_ids=False).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
