"""Language-model scoring with a log-bilinear neural model.

A token's class is itself for the most frequent words and the end; all other words are classed by their last two
characters (`SUFFIXES` classes), so that rare and unseen words give and take context too. How many words have a class
of their own grows with the corpus, as the fourth root of its tokens, so that the table of class pairs grows as their
square root. The log-bilinear model gives P(class | class before): score(w | h) = (R_h C) . Q_w + b_w, trained in
numpy by noise-contrastive estimation. As the model sees pairs of classes only, their counts over all training texts
are sufficient for its objective; Spark gathers them, and the expectation over the noise distribution is taken
exactly instead of by samples, so training is deterministic. Tasks get the factors and a normaliser for each class
before, whose size grows with the classes and not with their pairs; batched matrix products normalise, and scoring a
text multiplies the factors of each token and the one before. The words of a
suffix class share its probability by absolutely discounted counts, with one event for all unseen words.

Counts cover all training texts. Only the head of the count table (at most `head` words) is broadcast; counts of
rarer words reach their documents by a join on the word, exactly.

Defined cases: null texts are empty (their one token is the end); a null doc_id is not held out; repeated rows are
scored alike, row by row; without training texts every word is unseen; empty tables give no rows; other columns
are dropped.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.llm.common import LOWER_AZ, add_columns, broadcast_value, slices, written

#: The end of a text, as a word: no word is empty.
END = ""
END_CLASS = 0
#: Classes 1 to SUFFIXES hold the words without a class of their own, by a hash of their ends. A power of two.
SUFFIXES = 128
FLUSH = 200_000
HEAD_BYTES = 128 << 20
#: Pairs of classes that a task gathers before it merges or hands them on, and pairs scored at a time.
PAIRS, PART = 1_000_000, 1 << 16


def tokens(text: str | None) -> list[bytes]:
    """The words of text without the end."""
    return text.encode().translate(LOWER_AZ).split() if text else []


def suffix_class(word: bytes) -> int:
    end = word[-2:] if word[-2:].isascii() else word[-8:].decode("utf-8", "ignore")[-2:].encode()
    return 1 + xxhash.xxh64_intdigest(end, 42) % SUFFIXES


def suffix_class_of(word: str) -> Column:
    """suffix_class over a column."""
    return (F.pmod(F.xxhash64(F.substring(word, -2, 2)), F.lit(SUFFIXES)) + 1).cast("int")


class Classes(dict):
    """word -> class; words without one of their own are looked at once in a while."""

    def __init__(self, own: dict[bytes, int], most: int = 200_000):
        super().__init__(own)
        self.own, self.most = own, len(own) + most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.own)
        found = self[word] = suffix_class(word)
        return found


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of texts (one column); the end is the empty word."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
            counts.clear()
            return batch

        for b in slices(batches):
            for t in b.column(0).to_pylist():
                counts.update(tokens(t))
                counts[b""] += 1
                if len(counts) > FLUSH:
                    yield out()
        if counts:
            yield out()

    return texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def count_pairs(texts: DataFrame, classes: dict[bytes, int], n_classes: int) -> DataFrame:
    """(pair, c): how often class pair // n_classes is followed by class pair % n_classes; texts begin after the end."""

    def run(batches):
        known, kept = Classes(classes), Pairs()
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                words = tokens(t)
                ids = np.full(len(words) + 2, END_CLASS, np.int64)
                ids[1:-1] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                kept.add(ids[:-1] * n_classes + ids[1:])
            if len(kept) > PAIRS:
                yield kept.batch()
                kept = Pairs()
        yield kept.batch()

    return texts.mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))


class Pairs:
    """Counts of the pairs that occur; those added are merged in once they are many."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[np.ndarray] = []
        self.size = 0

    def add(self, pairs: np.ndarray) -> None:
        self.new.append(pairs)
        self.size += len(pairs)
        if self.size >= PAIRS:
            self.merge()

    def merge(self) -> None:
        keys, counts = np.unique(np.concatenate([*self.new, np.zeros(0, np.int64)]), return_counts=True)
        both, where = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.counts = np.bincount(where, np.concatenate([self.counts, counts]), len(both)).astype(np.int64)
        self.keys, self.new, self.size = both, [], 0

    def __len__(self) -> int:
        return len(self.keys)

    def batch(self) -> pa.RecordBatch:
        self.merge()
        return pa.RecordBatch.from_arrays([pa.array(self.keys), pa.array(self.counts)], names=["pair", "c"])


class LogBilinear:
    """log10 P(class | class before) out of factors and one normaliser a context, so that its size grows with the classes."""

    def __init__(self, hidden: np.ndarray, output: np.ndarray, bias: np.ndarray):
        self.hidden, self.output, self.bias = hidden.astype(np.float64), output.astype(np.float64), bias.astype(np.float64)
        self.norm = np.zeros(len(bias))
        for lo, hi in row_blocks(len(bias)):
            logits = self.hidden[lo:hi] @ self.output.T + self.bias
            top = logits.max(axis=1)
            self.norm[lo:hi] = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))

    @property
    def nbytes(self) -> int:
        return self.hidden.nbytes + self.output.nbytes + self.bias.nbytes + self.norm.nbytes

    def __len__(self) -> int:
        return len(self.bias)

    def __getitem__(self, at: tuple) -> np.ndarray:
        """Log-probabilities [before, class] of two arrays of classes, one for each pair, or of two classes."""
        before, after = at
        return ((self.hidden[before] * self.output[after]).sum(axis=-1) + self.bias[after] - self.norm[before]) / np.log(10)

    def total(self, ids: np.ndarray) -> float:
        """The sum over a text's classes, each after the one before, in parts of bounded size."""
        return float(sum(self[ids[i : i + PART][: len(ids) - 1 - i], ids[i + 1 : i + 1 + PART]].sum() for i in range(0, len(ids) - 1, PART)))


def row_blocks(n: int, most: int = 1 << 22) -> list[tuple[int, int]]:
    """Rows of an n by n matrix in blocks of bounded size."""
    step = max(1, most // max(n, 1))
    return [(lo, min(lo + step, n)) for lo in range(0, n, step)]


def train_log_bilinear(pairs: np.ndarray, **options) -> np.ndarray:
    """Normalised natural-log probabilities [before, class] from a small table of counts pairs[before, class]."""
    n = len(pairs)
    keys = np.flatnonzero(pairs)
    model = train_factors(keys, pairs.reshape(-1)[keys], n, **options)
    every = np.arange(n)
    return model[np.repeat(every, n), np.tile(every, n)].reshape(n, n) * np.log(10)


def train_factors(keys: np.ndarray, counts: np.ndarray, n: int, dim: int = 24, noise: int = 16, steps: int = 120, rate: float = 0.05, seed: int = 7) -> LogBilinear:
    """The model of n classes from the counts of pairs that occur (keys = before * n + class, rising).

    The objective looks at all n * n pairs; they are gone through in blocks of rows, so that memory grows with the classes and
    the pairs that occur.
    """
    total = max(float(counts.sum()), 1.0)
    rows = np.bincount(keys // n, counts, n) / total
    unigram = (np.bincount(keys % n, counts, n) + 0.5) / (counts.sum() + 0.5 * n)
    rng = np.random.default_rng(seed)
    p = {
        "R": rng.normal(0, 0.1, (n, dim)).astype(np.float32),
        "C": np.eye(dim, dtype=np.float32),
        "Q": rng.normal(0, 0.1, (n, dim)).astype(np.float32),
        "b": np.log(unigram).astype(np.float32),
    }
    shift = np.log(noise * unigram).astype(np.float32)
    noisy = (unigram * noise).astype(np.float32)
    blocks = [(lo, hi, *np.searchsorted(keys, (lo * n, hi * n))) for lo, hi in row_blocks(n)]
    share = (counts / total).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        hidden = p["R"] @ p["C"]
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        for lo, hi, start, stop in blocks:
            delta = np.clip(hidden[lo:hi] @ p["Q"].T + p["b"] - shift, -30, 30)
            real = 1 / (1 + np.exp(-delta))
            # Gradient of the expected NCE objective: data pull up by 1 - real, noise pushes down by real.
            g = -(rows[lo:hi, None].astype(np.float32) * noisy) * real
            flat = keys[start:stop] - lo * n
            g.reshape(-1)[flat] += share[start:stop] * (1 - real.reshape(-1)[flat])
            grads["Q"] += g.T @ hidden[lo:hi]
            grads["b"] += g.sum(axis=0)
            back = g @ p["Q"]
            grads["R"][lo:hi] = back @ p["C"].T
            grads["C"] += p["R"][lo:hi].T @ back
        for k in p:
            grads[k] -= 1e-7 * p[k]
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
            move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            p[k] = p[k] + rate * (1 - step / (steps + 1)) * move
    return LogBilinear(p["R"] @ p["C"], p["Q"], p["b"])


def fit(texts: DataFrame, growth: float = 10.0, head: int = 100_000) -> dict:
    """Counts and model from the one column of texts: a dict with the count table as a DataFrame and the driver's part.

    About `growth` times the fourth root of the tokens is how many words have a class of their own.
    """
    counts = written(count_words(texts), "lm-counts")
    # How many words have each count: a short table that gives totals, discounts and thresholds.
    shape = {r.c: r.n for r in counts.where(F.col("word") != END).groupBy("c").agg(F.count("*").alias("n")).collect()}
    ends = sum(r.c for r in counts.where(F.col("word") == END).collect())
    n_tokens = sum(c * n for c, n in shape.items()) + ends
    n_types = sum(shape.values()) + bool(ends)

    def above(most: float) -> int:
        """The least count such that at most `most` words have it or a larger one."""
        got, least = 0, max(shape, default=0) + 1
        for c in sorted(shape, reverse=True):
            got += shape[c]
            if got > most:
                break
            least = c
        return least

    in_model, in_head = above(growth * n_tokens**0.25), above(head)
    top = sorted(((r.word, r.c) for r in counts.where((F.col("word") != END) & (F.col("c") >= in_head)).collect()), key=lambda x: (-x[1], x[0]))
    own = {w.encode(): SUFFIXES + 1 + i for i, (w, c) in enumerate(top) if c >= in_model}
    n_classes = SUFFIXES + 1 + len(own)
    # Pairs that occur; their number is bounded by the square of the classes, that is by the square root of the tokens.
    gathered = count_pairs(texts, own, n_classes).toArrow()
    pairs, c = gathered.column("pair").to_numpy(), gathered.column("c").to_numpy()
    order = np.argsort(pairs)
    log_p = train_factors(pairs[order], c[order], n_classes)
    # Tokens and types of each suffix class.
    rest = counts.where((F.col("word") != END) & (F.col("c") < in_model)).groupBy(suffix_class_of("word").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n_rest, v_rest = np.zeros(SUFFIXES + 1), np.zeros(SUFFIXES + 1)
    for r in rest:
        n_rest[r.k], v_rest[r.k] = r.n, r.v
    once, twice = (shape.get(c, 0) if c < in_model else 0 for c in (1, 2))
    discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)
    # All classes spare the same share for unseen words, but those that have no other.
    share = discount * v_rest.sum() / n_rest.sum() if n_rest.sum() else 1.0
    seen = np.log10(np.where(v_rest > 0, (1 - share) / np.maximum(n_rest - discount * v_rest, 1e-9), 1.0))
    return {
        "counts": counts,
        "in_head": in_head,
        "n_tokens": n_tokens,
        "n_types": n_types,
        "ends": ends,
        "discount": discount,
        "seen": seen,
        "unseen": np.where(v_rest > 0, np.log10(share), 0.0),
        "words": {w.encode(): i for i, (w, _) in enumerate(top)},
        "c": np.array([c for _, c in top], np.int64),
        "class": np.array([SUFFIXES + 1 + i if c >= in_model else suffix_class(w.encode()) for i, (w, c) in enumerate(top)], np.int64),
        "log_p": log_p,
    }


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    small = {k: v for k, v in model.items() if k != "counts"}
    size = sum(len(w) + 120 for w in small["words"]) + sum(v.nbytes for v in small.values() if hasattr(v, "nbytes"))
    shared = broadcast_value(docs.sparkSession, small, HEAD_BYTES, size, "head of the word counts")

    def make():
        m = shared.value
        words, log_p = m["words"], m["log_p"]
        # Position -1 stands for a word outside the head: its class comes from its end, its count is unknown here.
        base_of = np.append(np.log10(m["c"] + 1.0), 0.0)
        class_of = np.append(m["class"], 0)
        in_rest = m["class"] <= SUFFIXES
        rest_of = np.append(np.where(in_rest, np.log10(np.maximum(m["c"] - m["discount"], 1e-9)) + m["seen"][np.where(in_rest, m["class"], 0)], 0.0), 0.0)
        end_base = float(np.log10(m["ends"] + 1.0))
        outside = Classes({})

        def one(t):
            w = tokens(t)
            n = len(w)
            at = np.fromiter((words.get(x, -1) for x in w), np.int64, n)
            ids = np.full(n + 2, END_CLASS, np.int64)
            ids[1:-1] = class_of[at]
            unknown = np.flatnonzero(at < 0)
            others = [w[i] for i in unknown.tolist()]
            ids[1 + unknown] = np.fromiter(map(outside.__getitem__, others), np.int64, len(others))
            base = float(base_of[at].sum()) + end_base
            s = log_p.total(ids) + float(rest_of[at].sum())
            rare = Counter(others)
            known = n - sum(rare.values()) + (m["ends"] > 0)
            return n + 1, int(known), base, s, [{"w": x.decode(), "k": k} for x, k in rare.items()]

        return one

    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.col(text).alias("__text"))
    scored = add_columns(keyed, ["__text"], make, "n long, known long, base double, lbl double, rare array<struct<w:string,k:long>>").drop("__text")
    # A row of its own for each document beside its rare words; no word holds the space that its join key begins with.
    own = F.struct(F.concat(F.lit(" "), F.col("key").cast("string")).alias("w"), F.lit(0).cast("long").alias("k"))
    flat = scored.select("key", "doc_id", F.explode(F.array_insert("rare", 1, own)).alias("r"), *[F.when(F.col("r.k") == 0, F.col(c)).alias(c) for c in ("n", "known", "base", "lbl")])
    tail = model["counts"].where((F.col("c") < model["in_head"]) & (F.col("word") != END)).withColumnRenamed("word", "w")
    joined = flat.select("key", "doc_id", "r.w", "r.k", "n", "known", "base", "lbl").join(tail, "w", "left")
    k, c = F.col("k"), F.col("c")
    by_class = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values[1:]]), suffix_class_of("w"))
    spread = F.when(c.isNotNull(), F.log10(c - model["discount"]) + by_class(model["seen"])).otherwise(by_class(model["unseen"]))
    sums = joined.groupBy("key", "doc_id").agg(
        F.sum("n").alias("n_tokens"),
        (F.sum("known") + F.sum(F.when(c.isNotNull(), k).otherwise(0))).alias("n_known"),
        (F.sum("base") + F.sum(k * F.log10(F.coalesce(c, F.lit(0)) + 1))).alias("base"),
        (F.sum("lbl") + F.sum(F.when(k > 0, k * spread).otherwise(0.0))).alias("score"),
    )
    each = float(np.log10(model["n_tokens"] + model["n_types"] + 1))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(model["n_tokens"]).cast("long").alias("train_tokens"), (F.col("base") - each * F.col("n_tokens")).alias("base_score"), "score")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast(T.BinaryType())), F.lit(7)) == 2, F.lit(False))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs.where(~held_out()).select("text"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
