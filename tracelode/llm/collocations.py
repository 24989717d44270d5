"""Phrase collocation mining with stripes: each prefix of words keys a counter of the words that follow it.

Texts become blocks of numbered words once. A block is counted as stripes, (lang, prefix) -> {next word: count}, which meet at their prefix and are merged
elementwise. The empty prefix holds the words themselves, so stripes of 0 to 4 words give every count that is needed: a
phrase's own (its extension of its prefix), the totals of both parts of a cut, and the largest count of a phrase with one
more word on either side, which is all that subsumption asks, as a longer phrase is never more frequent than a part of it.

Stripes of k words are counted only where both phrases of k - 1 words inside are frequent. Tasks know these by a bitmap of
hashes of a bounded size: a false alarm is counted and then dropped by its exact count, and nothing frequent is missed;
where a corpus has more phrases than the bitmap has room for, only the pruning grows weaker.

Nulls: a null text has no words, a null language is `und`. Empty tables give no rows. Repeated rows count as often as they
stand. Only the two named columns are read, so others may have any name. Long texts are read in blocks with the last words
carried over. Ties are ordered by score, count and phrase, which is unique in a language.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.llm.common import LOWER_AZ, broadcast_value, slices, written

#: A-Z lowered, the characters that end a piece as one, both kinds of space as one.
_PLAIN = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else LOWER_AZ[b] for b in range(256))
#: Bytes of a text read at a time, and words and distinct words of a block.
BLOCK, TOKENS, DISTINCT = 1 << 20, 1_000_000, 250_000
#: Bits of a bitmap: 16 a phrase, at most this many.
MOST_BITS = 1 << 27
#: Prefixes of so many occurrences have their stripes dealt to so many parts.
HOT, PARTS = 1 << 20, 64
_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Words (joined by spaces) and their numbers in the text, both compressed; the first of them were carried over.
TOKENISED = "lang string, words binary, ids binary, carried int"
#: The words that follow a prefix and how often, both joined by spaces; no counts where all are 1.
STRIPES = "lang string, prefix string, part int, nexts string, counts string"


class _Words(dict):
    """Numbers of the words met so far; 0 is no word, 1 the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})
        self.names = [b"", b"\n"]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(word)
        return n


def _seed(lang: str) -> int:
    return zlib.crc32(lang.encode())


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The place in a bitmap of so many bits (a power of two) of each hash of a phrase."""
    mixed = (hashes ^ (hashes >> np.uint64(29))) * _MIX
    return (mixed >> np.uint64(32)) & np.uint64(bits - 1)


def _marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = _slots(hashes, len(bitmap) * 64)
    return (bitmap[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) != 0


def _joined_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from those of their words, one array a place."""
    out = columns[0]
    for c in columns[1:]:
        out = out * _MULTIPLY + c
    return out


class _Block:
    """Words of one language in one task, numbered, as they are read; handed on as rows of TOKENISED."""

    def __init__(self, lang: str, most_words: int):
        self.lang, self.most_words = lang, most_words
        self.words, self.read, self.size, self.carried = _Words(), [], 0, 0

    def add(self, text: bytes) -> Iterator[tuple]:
        data = text.translate(_PLAIN)
        at = 0
        while at < len(data):
            cut = data.find(b" ", at + BLOCK) if len(data) - at > 2 * BLOCK else -1
            part = data[at:] if cut < 0 else data[at:cut]
            at = len(data) if cut < 0 else cut
            split = part.replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(self.words.__getitem__, split), np.int32, len(split))
            self.read.append(ids[ids != 0])
            self.size += len(self.read[-1])
            if self.size >= TOKENS or len(self.words.names) >= DISTINCT:
                yield from self.flush(self.most_words - 1)
        self.read.append(np.ones(1, np.int32))

    def flush(self, carry: int = 0) -> Iterator[tuple]:
        """What was read; the last `carry` words begin the next block too, as phrases begin in them that have not ended."""
        ids = np.concatenate(self.read) if self.read else np.zeros(0, np.int32)
        names = self.words.names
        if len(ids):
            yield self.lang, zlib.compress(b" ".join(names[2:]), 1), zlib.compress(ids.tobytes(), 1), self.carried
        kept = [names[i] for i in ids[len(ids) - min(carry, len(ids)) :]]
        self.words, self.size, self.carried = _Words(), 0, len(kept)
        self.read = [np.array([self.words[w] for w in kept], np.int32)] if kept else []


def tokenised(docs: DataFrame, most_words: int) -> DataFrame:
    """docs (lang, text) as blocks of numbered words, so that texts are cut into words once and not at every level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            columns = [list(c) for c in zip(*rows)]
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "words", "ids", "carried"])

        blocks: dict[str, _Block] = {}
        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                if lang not in blocks:
                    blocks[lang] = _Block(lang, most_words)
                for row in blocks[lang].add(text.as_py()):
                    yield batch([row])
            if sum(c.size for c in blocks.values()) > 2 * TOKENS:
                for block in blocks.values():
                    for row in block.flush():
                        yield batch([row])
        for block in blocks.values():
            for row in block.flush():
                yield batch([row])

    return docs.mapInArrow(run, TOKENISED)


class _Counted:
    """The phrases of k words of one block that may be frequent, by their places, and the hashes of words."""

    def __init__(self, lang: str, words: bytes, ids: bytes, carried: int, k: int, inside: np.ndarray | None):
        names = [b"", b"\n", *zlib.decompress(words).split(b" ")]
        # Phrases that lie in the carried words alone were counted with the block before.
        self.ids = ids = np.frombuffer(zlib.decompress(ids), np.int32)[max(0, carried - k + 1) :]
        self.words, self.k = pa.array(names, pa.binary()).cast(pa.string()), k
        seed = _seed(lang)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in names), np.uint64, len(names))
        word = ids > 1
        if k == 1:
            self.at = np.flatnonzero(word)
            return
        n = len(ids) - k + 2  # places of phrases of k - 1 words
        if n < 2:
            self.at = np.zeros(0, np.int64)
            return
        frequent = np.logical_and.reduce([word[j : j + n] for j in range(k - 1)])
        frequent &= _marked(inside, _joined_hash([self.hashes[ids[j : j + n]] for j in range(k - 1)]))
        self.at = np.flatnonzero(frequent[:-1] & frequent[1:])

    def phrase_hashes(self, size: int) -> np.ndarray:
        """Of the first `size` words at each place."""
        return _joined_hash([self.hashes[self.ids[self.at + j]] for j in range(size)])


def _stripe_rows(found: _Counted, lang: str, hot: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Stripes of a block; for k = 1 a row without a prefix holds the number of words."""
    at, ids, words, k = found.at, found.ids, found.words, found.k
    if not len(at):
        return
    width, following = len(words), ids[at + k - 1].astype(np.int64)
    if k == 1:
        yield _stripe_batch(lang, pa.array([None], pa.string()), [0, 1], [0], pa.array([""]), np.array([len(at)]))
        prefix, long = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    else:
        prefix, long = ids[at].astype(np.int64), _marked(hot, found.phrase_hashes(k - 1))
        for j in range(1, k - 1):
            prefix = np.unique(prefix * width + ids[at + j], return_inverse=True)[1]
    part = np.where(long, (found.hashes[following] % np.uint64(PARTS)).astype(np.int64), 0)
    entry, first, counts = np.unique((prefix * PARTS + part) * width + following, return_index=True, return_counts=True)
    stripe = entry // width
    starts = np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1]]))
    ends = np.concatenate([starts[1:], [len(entry)]])
    nexts = words.take(pa.array(entry % width))
    for lo in range(0, len(starts), 8192):
        some, last = starts[lo : lo + 8192], int(ends[min(lo + 8192, len(starts)) - 1])
        begin = int(some[0])
        heads = [words.take(pa.array(ids[at[first[some]] + j])) for j in range(k - 1)]
        prefixes = pc.binary_join_element_wise(*heads, " ") if k > 1 else pa.array([""] * len(some))
        yield _stripe_batch(lang, prefixes, np.append(some, last) - begin, stripe[some] % PARTS, nexts.slice(begin, last - begin), counts[begin:last])


def _stripe_batch(lang, prefixes, offsets, parts, nexts, counts) -> pa.RecordBatch:
    offsets = np.asarray(offsets)
    joined = lambda values: pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), " ")
    single = pa.array(np.maximum.reduceat(counts, offsets[:-1]) == 1)
    numbers = pc.if_else(single, pa.scalar(None, pa.string()), joined(pa.array(counts, pa.int64()).cast(pa.string())))
    columns = [pa.array([lang] * len(prefixes)), prefixes, pa.array(parts, pa.int32()), joined(nexts), numbers]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "prefix", "part", "nexts", "counts"])


def _each_block(batches: Iterator[pa.RecordBatch], k: int, inside) -> Iterator[tuple[str, _Counted]]:
    for b in batches:
        for i, (lang, carried) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist())):
            yield lang, _Counted(lang, b.column(1)[i].as_py(), b.column(2)[i].as_py(), carried, k, None if inside is None else inside.value)


def stripe_counts(blocks: DataFrame, k: int, inside=None, hot=None) -> DataFrame:
    """(lang, prefix, next, f) of phrases of k words, from blocks; for k = 1 a row with a null prefix counts all words.

    Stripes of hot prefixes are dealt by the hash of their next words, so that no key grows with the vocabulary; equal
    stripes of a block are one row, so that no key grows with the rows. The merge adds up in the same exchange that gathers
    a prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found in _each_block(batches, k, inside):
            yield from _stripe_rows(found, lang, None if hot is None else hot.value)

    stripes = blocks.mapInArrow(run, STRIPES).repartition("lang", "prefix", "part")
    # Where counts is missing, an empty array is filled up with nulls.
    counts = F.coalesce(F.split("counts", " ").cast("array<long>"), F.array().cast("array<long>"))
    zipped = F.arrays_zip(F.split("nexts", " ").alias("next"), counts.alias("f"))
    entries = stripes.select("lang", "prefix", "part", F.inline(zipped).alias("next", "f"))
    return entries.groupBy("lang", "prefix", "part", "next").agg(F.sum(F.coalesce("f", F.lit(1))).alias("f")).drop("part")


def _phrase() -> Column:
    return F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))


def phrase_bitmap(phrases: DataFrame, most_bits: int = MOST_BITS):
    """A broadcast bitmap of the hashes of phrases (lang, phrase); its size is bounded by most_bits, whatever their number."""
    bits, wanted = 1 << 16, 16 * phrases.count()
    while bits < wanted and bits < most_bits:
        bits *= 2

    def run(batches):
        for b in slices(batches, 8192):
            out = np.empty(b.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                seed = _seed(lang)
                out[i] = _joined_hash([np.array([xxhash.xxh64_intdigest(w, seed)], np.uint64) for w in phrase.encode().split(b" ")])[0]
            yield pa.RecordBatch.from_arrays([pa.array(_slots(out, bits).astype(np.int64))], names=["slot"])

    slots = phrases.select("lang", "phrase").mapInArrow(run, "slot long")
    rows = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return broadcast_value(phrases.sparkSession, bitmap, most_bits // 8, bitmap.nbytes, "bitmap of phrases")


def count_phrases(docs: DataFrame, least: int = 100, most_words: int = 5, text: str = "text", lang: str = "lang", most_bits: int = MOST_BITS, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """((lang, n) of all words, (lang, k, prefix, next, phrase, f) of all phrases of 1 to most_words words found least times or more)."""
    plain = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    blocks = written(tokenised(plain, most_words), "phrases-blocks")
    words = written(stripe_counts(blocks, 1).where((F.col("f") >= least) | F.col("prefix").isNull()), "phrases-1")
    totals = written(words.where(F.col("prefix").isNull()).select("lang", F.col("f").alias("n")), "phrases-totals")
    found = level = words.where(F.col("prefix").isNotNull()).select("lang", F.lit(1).alias("k"), "prefix", "next", _phrase().alias("phrase"), "f")
    for k in range(2, most_words + 1):
        if level.isEmpty():
            break
        inside = phrase_bitmap(level, most_bits)
        counts = stripe_counts(blocks, k, inside, phrase_bitmap(level.where(F.col("f") >= hot), most_bits)).where(F.col("f") >= least)
        level = written(counts.select("lang", F.lit(k).alias("k"), "prefix", "next", _phrase().alias("phrase"), "f"), f"phrases-{k}")
        found = found.unionByName(level)
    return totals, found


def mine(totals: DataFrame, found: DataFrame, contained_share: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of candidates of two words or more that no longer phrase accounts for.

    A phrase goes where a longer one has contained_share per cent of its count or more. The score, 1000 * a * n / (l * r)
    rounded down, is that of the lowest cut; products are decimals of 38 digits.
    """
    long = found.where(F.col("k") > 1)
    inside = long.select("lang", F.col("prefix").alias("phrase"), "f").unionByName(
        long.select("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "f")
    )
    longer = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = long.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < contained_share * F.col("f"), F.lit(True)))
    split = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), split.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.size("w")).alias("rest"))
    of = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    counted = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"{wide('1000 * a')} * {wide('n')} div ({wide('l')} * {wide('r')})").cast("long")
    lowest = counted.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low"))
    return lowest.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")


def top_phrases(mined: DataFrame, per_lang: int = 2000) -> DataFrame:
    """The first phrases of each language, ranked by score, count and phrase; tasks hand on at most per_lang rows a language."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_phrases(mine(*count_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)
), c AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE k >= 2 AND f >= 100),
inside AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand)) GROUP BY ALL
), kept AS (SELECT cand.* FROM cand LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS fst, array_to_string(w[cut + 1 :], ' ') AS rst FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cut, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN c x ON x.lang = cuts.lang AND x.phrase = fst JOIN c y ON y.lang = cuts.lang AND y.phrase = rst JOIN n ON n.lang = cuts.lang
), low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low WHERE o = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""
