"""SentencePiece encoding and decoding as a max-plus parallel scan over text chunks.

A BPE model's encoding is the one path through the lattice of pieces in which every two neighbours are such that
the merges, applied to their joined text alone, give back exactly these two. So arcs weigh 0 where neighbours are
compatible and minus infinity where not, and the encoding is the max-plus product of the text's arcs: it equals
what the merges give, whatever the length of the text. (The model file at hand is BPE with byte fallback; scores
only order its merges, so a path of highest summed score would not be its encoding.)

* A text is cut into chunks. No piece reaches across the place where a non-space is followed by a space, so a
  chunk ends there where it can, and its boundary has one state. Elsewhere (scripts without spaces, endless
  words) the states of a boundary are the pieces that may be the last to end at or before it.
* Each chunk yields a transfer matrix: which exit states each entry state reaches, as bit sets over the entries.
* Matrices combine associatively (`compose`) in a tree over tasks: neighbours by twos, level by level, up to one
  matrix a text. On the way down each pair tells the one state between its two halves that lies on the path.
* Each chunk is then backtraced on its own between its two states.

Chunks of one text are spread over tasks, and no task holds more than two matrices of a text. Where no piece crosses
a chunk's two ends its matrix has one entry, one exit and weight 0 without a look inside. Texts of one chunk need no
shuffle. Words are looked up in a bounded cache; a word that is not there goes through the lattice.

Defined cases: null and empty texts have no ids; repeated rows are encoded alike; characters without a piece
become byte pieces; U+2581 in a text is taken for a space, as the format does; decoding drops control ids and
turns broken byte runs into U+FFFD; empty tables give no rows; other columns pass through, but those with the
names of the results are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.llm.common import broadcast_value, numbered, shared_dir, slices, written

SPACE = "▁"
CHUNK = 1 << 15
CACHE = 200_000
PAIRS = 400_000
#: Characters without a piece that are kept between texts; a text of more has them all while it is read.
UNKNOWN = 50_000
MODEL_BYTES = 64 << 20
#: The boundary state where no piece crosses: before the first piece, at such a cut, and after the last piece.
START = (0, 0)
#: Giant texts or chunks that a task holds as Python objects at once.
GIANTS = 8
#: Characters of a text that the table of beginnings tells apart.
HEAD = 5
RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def load_model(path: str) -> dict:
    """Pieces, scores and kinds of a SentencePiece model file, read on the driver."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only BPE models without normalisation are read")
    return {
        "pieces": [p.piece for p in proto.pieces],
        "scores": [p.score for p in proto.pieces],
        "kinds": [p.type for p in proto.pieces],
        "dummy": proto.normalizer_spec.add_dummy_prefix,
    }


class Codec:
    """One task's tables over a model, with bounded caches."""

    def __init__(self, model: dict):
        kinds = model["kinds"]
        self.names = ["", *model["pieces"]]
        self.size = len(self.names)
        self.packed = [b"", *[np.int32(i).tobytes() for i in range(len(model["pieces"]))]]
        self.ids = {p: i + 1 for i, p in enumerate(model["pieces"]) if kinds[i] == 1}
        self.ids_beyond: dict[str, int] = {}
        self.score = {p: model["scores"][i - 1] for p, i in self.ids.items()}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(model["pieces"]) if kinds[i] == 6}
        self.unk = next(i for i, k in enumerate(kinds) if k == 2)
        self.longest = max(map(len, self.ids), default=1)
        longer: dict[str, set[int]] = defaultdict(set)
        for p in self.ids:
            if len(p) > HEAD:
                longer[p[:HEAD]].add(len(p))
        #: Beginnings of pieces, of 2 to HEAD characters -> (length, number) of the pieces that a text with such a
        #: beginning, and no longer one, has there; longest first, a number that has yet to be looked up as None.
        heads = {p[:k] for p in self.ids for k in range(2, min(HEAD, len(p)) + 1)}
        self.by_head = {}
        for h in heads:
            exact = [(k, self.ids[h[:k]]) for k in range(len(h), 1, -1) if h[:k] in self.ids]
            self.by_head[h] = (*[(n, None) for n in sorted(longer.get(h, ()), reverse=True)], *exact, (1, self.number(h[0])))
        self.dummy = SPACE if model["dummy"] else ""
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.lines = self.cuts and not any("\n" in p for p in self.ids)
        #: Two characters that no piece has side by side: text can be cut between them.
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.pairs: dict[int, bool] = {}
        self.newline = self.packed[self.number("\n")]
        self.spaced, self.bare = Words(self, SPACE), Words(self, "")
        #: Numbers from here on are of characters met in texts; those before are part of the tables.
        self.first_beyond = len(self.names)

    def merges(self, text: str) -> list[str]:
        """The merges themselves, for a few pieces' text: best score first, leftmost among equals."""
        symbols, score = list(text), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def number(self, piece: str) -> int:
        """A piece's number: its id plus 1, beyond all ids for a character without a piece; 0 is the start."""
        known = self.ids.get(piece)
        if known is None:
            known = self.ids_beyond.get(piece)
            if known is None:
                known = self.ids_beyond[piece] = len(self.names)
                self.names.append(piece)
                got = [self.byte.get(x) for x in piece.encode()]
                self.packed.append(np.array(got if None not in got else [self.unk], np.int32).tobytes())
        return known

    def trim(self) -> None:
        """Forgets characters without a piece, once there are many of them, and what is kept under their numbers; called between texts."""
        if len(self.names) > self.first_beyond + UNKNOWN:
            for piece in self.names[self.first_beyond :]:
                del self.ids_beyond[piece]
            del self.names[self.first_beyond :], self.packed[self.first_beyond :]
            self.pairs.clear()

    def follows(self, a: int, b: int) -> bool:
        """The arc weight between neighbours: True for 0, False for minus infinity. a is 0 at a text's start."""
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            x, y = self.names[a], self.names[b]
            found = self.pairs[key] = self.merges(x + y) == ([x, y] if a else [y])
        return found

    def pack(self, pieces: list[int]) -> bytes:
        packed = self.packed
        return b"".join([packed[i] for i in pieces])

    def transfer(self, left: str, body: str, start: bool, end: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """(entry states, [(exit offset, exit length, bits of the entries that reach it)]) of one chunk.

        left: the text before body that entry and straddling pieces may reach into, empty if start. A state is
        (characters between the piece's end and the boundary, length of the piece).
        """
        text, b, longest = left + body, len(left), self.longest
        if not end and len(body) < longest:
            raise ValueError("a chunk must be longer than any piece")
        known = self.ids
        if start:
            entries = [START]
            at: dict[int, list[tuple[int, int, int]]] = {b: [(0, 0, 1)]}
        else:
            entries, at = [], {}
            for p in range(max(1, b - longest + 1), b + 1):
                for n in range(1, min(longest, p) + 1):
                    if n == 1 or text[p - n : p] in known:
                        at.setdefault(p, []).append((self.number(text[p - n : p]), n, 1 << len(entries)))
                        entries.append((b - p, n))
        for p in range(b + 1, len(text) + 1):
            found = []
            for n in range(1, min(longest, p) + 1):
                piece = text[p - n : p]
                if (n == 1 or piece in known) and (before := at.get(p - n)):
                    mask, here = 0, self.number(piece)
                    for other, _, bits in before:
                        if bits & ~mask and self.follows(other, here):
                            mask |= bits
                    if mask:
                        found.append((here, n, mask))
            if found:
                at[p] = found
            if p - 2 * longest - 1 > b:
                at.pop(p - 2 * longest - 1, None)
        stop = len(text)
        first = stop if end else max(b + 1, stop - longest + 1)
        exits = [(stop - p, n, mask) for p in range(first, stop + 1) for _, n, mask in at.get(p, ()) if p > b]
        return entries, exits

    def path(self, left: str, body: str, entry: tuple[int, int], leave: tuple[int, int] | None) -> list[int]:
        """The pieces (as numbers) after the entry state up to the exit state (None: the end of body).

        At most one path of weight 0 leads from an entry state to any place, so the search goes depth first, longest
        pieces first, and never returns to a place from which the end was not reached.
        """
        text, heads, ids, pairs, number = left + body, self.by_head, self.ids, self.pairs, self.number
        place = len(left) if entry == START else len(left) - entry[0]
        stop = len(text) if leave is None else len(text) - leave[0]
        first = 0 if entry == START else number(text[place - entry[1] : place])
        before, out, dead = first, [], None
        limit = stop - place
        while place < stop:
            head = text[place : place + HEAD]
            found = heads.get(head) or heads.get(head[:4]) or heads.get(head[:3]) or heads.get(head[:2]) or ((1, number(head[0])),)
            for n, piece in found:
                if n > limit:
                    continue
                if piece is None:
                    piece = ids.get(text[place : place + n])
                    if piece is None:
                        continue
                if dead and place + n in dead:
                    continue
                good = pairs.get(before << 32 | piece)
                if good is None:
                    good = self.follows(before, piece)
                if good:
                    out.append((piece, n))
                    before = piece
                    place += n
                    limit = stop - place
                    break
            else:
                dead = dead or set()
                dead.add(place)
                place -= out.pop()[1]
                limit = stop - place
                before = out[-1][0] if out else first
                # The place is tried again; what was dead stays dead.
        return [piece for piece, _ in out]

    def encode_whole(self, text: str | None, head: bool = True) -> bytes:
        """Ids (int32) of text between cuts; head: text begins the document."""
        if not text:
            return b""
        if SPACE in text or not self.lines:
            return self._runs((self.dummy if head else "") + text.replace(" ", SPACE))
        lines = text.split("\n")
        if head and self.dummy:
            lines[0] = " " + lines[0]
        out = []
        spaced, bare = self.spaced, self.bare
        for line in lines:
            words = line.split(" ")
            first = words[0]
            rest = words[1:]
            if "" in rest:
                out.append(self._runs(line.replace(" ", SPACE)))
            else:
                out.append((bare[first] if first else b"") + b"".join(map(spaced.__getitem__, rest)))
        return self.newline.join(out)

    def _runs(self, text: str) -> bytes:
        if not self.cuts:
            return self.pack(self.path("", text, START, None))
        return b"".join(map(self.bare.__getitem__, RUNS.findall(text)))


def piece_bytes(model: dict) -> list[bytes]:
    """What each id stands for in a text: control ids nothing, byte pieces their byte."""
    kinds = zip(model["pieces"], model["kinds"])
    return [b"" if k == 3 else b" \xe2\x81\x87 " if k == 2 else bytes([int(p[3:5], 16)]) if k == 6 else p.replace(SPACE, " ").encode() for p, k in kinds]


_CODECS: dict[int, Codec] = {}


def codec_of(shared) -> Codec:
    """The Codec of a broadcast model, kept with its caches for later tasks of the same Python process."""
    model = shared.value
    if id(model) not in _CODECS:
        _CODECS.clear()
        _CODECS[id(model)] = Codec(model)
        _CODECS[id(model)].model = model  # kept alive, so that its id is not given to another
    _CODECS[id(model)].trim()
    return _CODECS[id(model)]


class Words(dict):
    """word -> its ids; words come with or without the space before them."""

    def __init__(self, codec: Codec, before: str):
        super().__init__()
        self.codec, self.before = codec, before

    def __missing__(self, word: str) -> bytes:
        beside, bare = self.codec.beside, self.codec.bare
        parts, begin = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in beside:
                parts.append(word[begin:i])
                begin = i
        if parts:
            parts.append(word[begin:])
            # No part has a cut inside, so that looking one up goes no deeper.
            found = b"".join([self[parts[0]], *map(bare.__getitem__, parts[1:])])
        else:
            found = self.codec.pack(self.codec.path("", self.before + word, START, None))
        if len(word) <= 48:
            if len(self) > CACHE:
                for old in list(islice(self, CACHE // 2)):
                    del self[old]
            self[word] = found
        return found


def compose(a: dict, b: dict) -> dict:
    """Max-plus product of two transfer matrices {entry: set of exits}: associative."""
    return {i: got for i, mid in a.items() if (got := set().union(*[b.get(m, ()) for m in mid]))}


def between(a: dict, b: dict, entry: tuple, leave: tuple) -> tuple:
    """The one state between two matrices on the path from entry to leave."""
    states = [m for m in a.get(entry, ()) if leave in b.get(m, ())]
    if len(states) != 1:
        raise ValueError(f"a boundary has {len(states)} states")
    return states[0]


def cut_points(text: str, chunk: int, cuts: bool) -> list[tuple[int, bool]]:
    """(place, whether no piece crosses it) of the boundaries inside text, in which spaces are SPACE."""
    out, at = [], 0
    while len(text) - at > chunk:
        place, clean = at + chunk, False
        if cuts:
            p = text.rfind(SPACE, at + chunk // 2, place)
            while p > at and text[p - 1] == SPACE:
                p -= 1
            if p > at + chunk // 4:
                place, clean = p, True
        out.append((place, clean))
        at = place
    return out


def _list_array(parts: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False))


def encode(docs: DataFrame, model_path: str, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs plus ids array<int>."""
    spark = docs.sparkSession
    model = load_model(model_path)
    shared = broadcast_value(spark, model, MODEL_BYTES, sum(len(p) + 100 for p in model["pieces"]), "pieces")
    names = [c for c in docs.columns if c != "ids"]
    docs = numbered(docs.select(*[F.col(f"`{c}`") for c in names]))
    where, text = names.index(text), f"d_{names.index(text)}"
    out = T.StructType([*docs.schema.fields, IDS])

    def whole(batches):
        codec = codec_of(shared)
        for b in slices(batches, 128):
            parts = []
            for t in b.column(where).to_pylist():
                codec.trim()
                parts.append(codec.encode_whole(t))
            yield pa.RecordBatch.from_arrays([*b.columns, _list_array(parts).cast(pa.list_(pa.int32()))], names=[*b.schema.names, "ids"])

    giant = F.length(text) > chunk
    short = docs.where(F.coalesce(~giant, F.lit(True))).mapInArrow(whole, out)
    both = short.unionByName(_encode_giants(docs.where(giant), shared, text, chunk))
    return both.toDF(*names, "ids")


ARCS = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
ARCS_DDL = "array<struct<a:array<int>,b:array<int>>>"


def _arcs(matrix: dict) -> list[dict]:
    return [{"a": list(a), "b": list(b)} for a, found in matrix.items() for b in found]


def _matrix(arcs: list[dict]) -> dict:
    out = defaultdict(set)
    for arc in arcs:
        out[tuple(arc["a"])].add(tuple(arc["b"]))
    return out


def _settle(level: DataFrame, ends: tuple) -> DataFrame:
    """(key, no, entry, leave) of (key, no, arcs): each chunk's two boundary states, by combining matrices in a tree."""

    def up(batches):
        for b in batches:
            out = []
            for kids in b.column(2).to_pylist():
                both = [_matrix(k["arcs"]) for k in sorted(kids, key=lambda k: k["no"])]
                out.append(_arcs(both[0] if len(both) == 1 else compose(*both)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, ARCS)], names=["key", "no", "arcs"])

    def down(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                kids = sorted(r["kids"], key=lambda k: k["no"])
                states = [r["entry"], r["leave"]]
                if len(kids) == 2:
                    states.insert(1, list(between(*[_matrix(k["arcs"]) for k in kids], tuple(r["entry"]), tuple(r["leave"]))))
                rows += [(r["key"], k["no"], x, y) for k, x, y in zip(kids, states, states[1:])]
            cols = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(cols, kinds)], names=["key", "no", "entry", "leave"])

    pairs = []
    last = level.agg(F.max("no")).first()[0] or 0
    while last > 0:
        kids = level.groupBy("key", F.floor(F.col("no") / 2).cast("int").alias("no")).agg(F.collect_list(F.struct("no", "arcs")).alias("kids"))
        pairs.append(written(kids, "matrix-pairs"))
        level = pairs[-1].mapInArrow(up, f"key long, no int, arcs {ARCS_DDL}")
        last //= 2
    state = F.array(*[F.lit(x) for x in ends]).cast("array<int>")
    found = level.select("key", "no", state.alias("entry"), state.alias("leave"))
    for kids in reversed(pairs):
        found = kids.join(found, ["key", "no"]).mapInArrow(down, "key long, no int, entry array<int>, leave array<int>")
    return found


def _encode_giants(giants: DataFrame, shared, text: str, chunk: int) -> DataFrame:
    """giants plus ids, each text in chunks that are spread over tasks."""
    shared_dir(giants.sparkSession)
    pieces = T._parse_datatype_string("key long, no int, left string, body string, start boolean, end boolean, last boolean")

    def split(batches):
        codec = codec_of(shared)
        reach, size = 2 * codec.longest, max(chunk, 4 * codec.longest)
        for b in slices(batches, GIANTS):
            rows = []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = codec.dummy + t.replace(" ", SPACE)
                bounds = [(0, True), *cut_points(t, size, codec.cuts), (len(t), True)]
                for no, ((p, start), (q, end)) in enumerate(zip(bounds, bounds[1:])):
                    rows.append((key, no, "" if start else t[max(0, p - reach) : p], t[p:q], start, end, q == len(t)))
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()))], names=pieces.names)

    # The giants themselves are written with their keys, so that keys stay the same whatever is recomputed.
    kept = written(giants.withColumn("key", F.monotonically_increasing_id()), "giants")
    keyed = kept.select("key", F.col(text).alias("whole"))
    chunks = written(keyed.mapInArrow(split, pieces).repartition("key", "no"), "chunks")

    def transfers(batches):
        codec = codec_of(shared)
        for b in slices(batches, GIANTS):
            rows = []
            for r in b.to_pylist():
                codec.trim()
                if r["start"] and r["end"]:
                    rows.append((r["key"], r["no"], _arcs({START: {START}})))
                    continue
                entries, exits = codec.transfer(r["left"], r["body"], r["start"], r["end"])
                matrix = defaultdict(set)
                for o, n, mask in exits:
                    for i, state in enumerate(entries):
                        if mask >> i & 1:
                            matrix[state].add(START if r["end"] else (o, n))
                rows.append((r["key"], r["no"], _arcs(matrix)))
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(cols, (pa.int64(), pa.int32(), ARCS))], names=["key", "no", "arcs"])

    level = written(chunks.mapInArrow(transfers, f"key long, no int, arcs {ARCS_DDL}"), "matrices")
    found = _settle(level, START)
    def trace(batches):
        codec = codec_of(shared)
        for b in slices(batches, GIANTS):
            parts = []
            for r in b.to_pylist():
                codec.trim()
                if r["start"] and r["end"]:
                    parts.append(codec._runs(r["body"]))
                else:
                    leave = tuple(r["leave"])
                    parts.append(codec.pack(codec.path(r["left"], r["body"], tuple(r["entry"]), None if leave == START else leave)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _list_array(parts).cast(pa.list_(pa.int32()))], names=["key", "no", "ids"])

    traced = chunks.join(found, ["key", "no"]).select("key", "no", "left", "body", "start", "end", "entry", "leave").mapInArrow(trace, "key long, no int, ids array<int>")
    joined = traced.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))
    return kept.join(joined, "key").drop("key")


def decode(encoded: DataFrame, model_path: str, name: str = "decoded") -> DataFrame:
    """encoded plus the text of its ids."""
    model = load_model(model_path)
    shared = broadcast_value(encoded.sparkSession, model, MODEL_BYTES, sum(len(p) + 100 for p in model["pieces"]), "pieces")
    names = [c for c in encoded.columns if c != name]
    encoded = numbered(encoded.select(*[F.col(f"`{c}`") for c in names]))
    where = names.index("ids")

    def run(batches):
        table, dummy = piece_bytes(shared.value), shared.value["dummy"]
        for b in slices(batches, 128):
            column = b.column(where)
            flat, offsets = column.flatten().to_numpy(zero_copy_only=False), 0
            out = []
            for n in column.value_lengths().to_pylist():
                if n is None:
                    out.append(None)
                    continue
                raw = b"".join(map(table.__getitem__, flat[offsets : offsets + n].tolist())).decode("utf-8", "replace")
                offsets += n
                out.append(raw[1:] if dummy and raw.startswith(" ") else raw)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "text"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())])).toDF(*names, name)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding the ids gives the text back."""
    path = model_path or default_model()
    digest = lambda c: F.unhex(F.sha2(F.coalesce(c, F.lit("")), 256))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", digest("text").alias("said"))
    # Texts do not go through the second map beside their ids: their digests stand for them.
    back = decode(encode(docs, path).drop("text"), path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (digest("decoded") == F.col("said")).alias("round_trip"))
