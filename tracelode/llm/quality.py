"""Quality rules under weak supervision.

Each rule votes good (1), bad (0) or abstains (-1) on a document. Expectation-maximisation over the counts of vote
patterns estimates each rule's accuracy and coverage in good and in bad documents (rules independent given the
class), and a document is kept if its posterior probability of being good reaches a threshold: no rule alone
decides. Patterns are counted over all documents in Spark; the driver sees at most `max_patterns` pattern rows
(3 to the power of the rules bounds them), so its memory does not grow with the corpus.

Defined cases: null texts have no words; repeated rows are judged alike; a document on which all rules abstain
gets the prior; with no rows there are no rows; other columns pass through, but those with the names of the
results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.common import LOWER_AZ, add_columns, written

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_ends long, n_upper long, n_letters long, n_distinct long, n_bars long"
#: Symbols of the fixed class `[#*$%&|<>]`, as bytes to delete.
SYMBOL_BYTES = b"#*$%&|<>"
CONTINUED = bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))
LETTERS = bytes([*range(65, 91), *range(97, 123)])


def measure(text: str | None) -> tuple[int, ...]:
    """The features of one text, in the order of FEATURES."""
    if not text:
        return (0,) * 10
    data = text.encode()
    words = data.split()
    n = len(words)
    # Code points of words: bytes that are not white space and do not continue a code point.
    joined = b"".join(words)
    word_chars = len(joined.translate(None, CONTINUED))
    n_symbols = len(data) - len(data.translate(None, SYMBOL_BYTES))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    n_dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            hit = bytearray(n)
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    hit[i] = hit[i + 1] = hit[i + 2] = 1
            repeat = sum(hit)
    ends = sum(map(data.count, (b". ", b".\n", b"! ", b"? "))) + data.endswith((b".", b"!", b"?"))
    upper = len(data) - len(data.translate(None, UPPER))
    letters = len(data) - len(data.translate(None, LETTERS))
    return n, word_chars, n_symbols, n_dup, repeat, ends, upper, letters, len(set(data.translate(LOWER_AZ).split())), data.count(b" | ")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def _bad(bad: Column) -> Column:
    return F.when(bad, 0).otherwise(-1)


def rules() -> dict[str, Column]:
    """Votes over the features. Defects vote bad or abstain; only signs of prose vote good."""
    n, chars, letters = F.col("n_words"), F.col("word_chars"), F.col("n_letters")
    per = lambda c, of: F.col(c) / F.greatest(F.lit(1), of)
    enough = n >= 20
    prose = per("n_ends", n).between(0.02, 0.3) & (per("n_symbols", n) < 0.1) & (per("n_upper", letters) < 0.3)
    return {
        "symbols": _vote(per("n_symbols", n) < 0.05, per("n_symbols", n) > 0.3),
        "sentences": _vote(prose, enough & ((per("n_ends", n) < 0.004) | (per("n_ends", n) > 0.5))),
        "variety": F.when(enough, _vote(per("n_distinct", F.sqrt(n)) > 4.0, per("n_distinct", F.sqrt(n)) < 1.5)).otherwise(-1),
        "repeats": _bad(enough & (per("n_repeat_words", n) > 0.4)),
        "dup_lines": _bad(F.col("n_dup_lines") > F.greatest(F.lit(2), n / 20)),
        "upper": _bad(enough & (per("n_upper", letters) > 0.6)),
        "word_length": _bad((n > 0) & ((chars < 2 * n) | (chars > 25 * n))),
        "tables": _bad(enough & (per("n_bars", n) > 0.2)),
        "length": _bad(n < 5),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, start: float = 0.8, prior: float = 0.85) -> dict:
    """EM over (votes, count): {'prior', 'vote' [rule, class, vote] probabilities, 'posterior' {pattern: probability of good}}."""
    if not patterns:
        return {"prior": prior, "vote": np.zeros((0, 2, 3)), "posterior": {}}
    votes = np.array([p for p, _ in patterns], dtype=int).reshape(len(patterns), -1)
    weight = np.array([c for _, c in patterns], dtype=float)
    m = votes.shape[1]
    shown = np.stack([votes == v for v in (0, 1, -1)], axis=2)  # pattern, rule, vote
    # Rules start as better than chance, which also fixes which class is the good one.
    table = np.zeros((m, 2, 3))
    cover = (shown[:, :, :2] * weight[:, None, None]).sum(axis=(0, 2)) / max(weight.sum(), 1)
    for c in (0, 1):
        table[:, c, c], table[:, c, 1 - c], table[:, c, 2] = start * cover, (1 - start) * cover, 1 - cover
    table = (table + 1e-6) / (table + 1e-6).sum(axis=2, keepdims=True)

    def posterior() -> np.ndarray:
        like = np.einsum("prv,rcv->pc", shown, np.log(table)) + np.log([1 - prior, prior])
        like = np.exp(like - like.max(axis=1, keepdims=True))
        return like[:, 1] / like.sum(axis=1)

    good = posterior()
    for _ in range(rounds):
        each = np.stack([weight * (1 - good), weight * good])
        # One pseudo-vote of the starting accuracy keeps every rule on the side it was written for.
        counts = np.einsum("cp,prv->rcv", each, shown) + np.array([[start, 1 - start, 1], [1 - start, start, 1]])
        table = counts / counts.sum(axis=2, keepdims=True)
        prior = float(np.clip((each[1].sum() + 1) / (weight.sum() + 2), 0.02, 0.98))
        after = posterior()
        if np.abs(after - good).max() < 1e-9:
            good = after
            break
        good = after
    return {"prior": prior, "vote": table, "posterior": {p: float(g) for (p, _), g in zip(patterns, good)}}


def judge(docs: DataFrame, text: str = "text", votes: Callable[[], dict[str, Column]] = rules, threshold: float = 0.5, max_patterns: int = 60_000) -> DataFrame:
    """docs (without the text) plus the features, base_failed, p_good and kept."""
    spark = docs.sparkSession
    slim = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("votes", "p_good", "base_failed", "kept")])
    measured = add_columns(slim, [text], lambda: lambda t: measure(t), FEATURES).drop(text)
    chosen = votes()
    if 3 ** len(chosen) > max_patterns:
        raise ValueError("too many rules for a bounded table of patterns")
    voted = written(measured.withColumn("votes", F.array(*[v.cast("int") for v in chosen.values()])), "quality")
    counted = voted.groupBy("votes").agg(F.count("*").alias("c")).collect()
    model = fit(sorted((tuple(r.votes), r.c) for r in counted))
    found = spark.createDataFrame([(list(p), g) for p, g in model["posterior"].items()], "votes array<int>, p_good double")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # At most max_patterns rows: the side to broadcast is bounded by the number of rules.
    return (
        voted.join(F.broadcast(found), "votes", "left")
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("p_good", F.lit(model["prior"])) >= threshold))
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def brute(text: str | None) -> tuple[int, ...]:
    """n_words to n_repeat_words by the plain definitions, for tests."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, c in Counter(windows).items() if c > 1}
    marked = set(chain.from_iterable(range(i, i + 3) for i, w in enumerate(windows) if w in twice))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)
