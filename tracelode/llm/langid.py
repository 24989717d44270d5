"""Language identification by word-first backoff.

Known words are scored by their log frequency in each language; an unseen word falls back, position by position,
to the longest known character n-gram that ends there (4, 3, 2, then 1 characters; words carry edge marks), and a
gram that no language has adds the same to all. A run of more than `LONG` letters, as in scripts without spaces, is
read whole, every `LONG` letters of it counting as one word. A document's languages are compared by the sum over its
words.

Training reads a bounded sample of labelled rows: at most about `max_train_docs`, dealt evenly over the languages and
chosen by a hash of doc_id, so that growth of the corpus does not grow the model and a rare language has its rows.
The model holds words and n-grams that occur more than once in a language, and of those the most frequent: about
`max_words` and `max_grams` a language. Prediction reads every whole text, and what the model does not hold is scored
by backoff.

Defined cases: text that is null or has no letter (Unicode's L) is `und` with score 0; so is every text if there was
nothing to learn from; ties go to the language first in order; repeated rows are answered alike; no rows give no rows;
other columns pass through, but those with the names of the results are replaced.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.llm.common import add_columns, broadcast_value, numbered, renamed, written

LETTERS = regex.compile(r"\p{L}+")
ORDERS = (4, 3, 2, 1)
UNKNOWN = "und"
#: Bound of the broadcast tables; words and grams are at most some 80 bytes each.
MODEL_BYTES = 256 << 20
CACHE = 200_000
LONG = 64


def train(docs: DataFrame, usable: Column | None = None, max_train_docs: int = 20_000, max_words: int = 30_000, max_grams: int = 20_000) -> dict:
    """{'langs', 'words': {word: row}, 'grams': {gram: row}, 'table': log frequencies} from docs' text and lang."""
    labelled = docs.where(F.col("lang").isNotNull() & (F.lit(True) if usable is None else usable)).select("doc_id", "lang", "text")
    # One row a language.
    total = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not total:
        return {"langs": [], "words": {}, "grams": {}, "word_rows": np.zeros((0, 0)), "gram_rows": np.zeros((0, 0))}
    each = max(1, max_train_docs // len(total))
    share = _by_language({lang: min(1.0, each / n) for lang, n in total.items()})
    sample = labelled.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000)) < share * 1_000_000).where(F.col("text").isNotNull())
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("c"))
    words = written(words, "langid-words")
    marked = F.concat(F.lit("_"), F.col("w"), F.lit("_"))
    gram = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1))), lambda i: F.substr(marked, i, F.lit(n)))
    grams = words.select("lang", "c", F.explode(F.concat(*[gram(n) for n in ORDERS])).alias("w")).groupBy("lang", "w").agg(F.sum("c").alias("c")).where("c > 1")
    grams = written(grams, "langid-grams")

    def top(seen: DataFrame, k: int) -> list:
        """Each language's rows above the least count that at most k rows reach; how many rows have each count tells it."""
        left: dict[str, int] = {}
        least: dict[str, int] = {}
        part: dict[str, float] = {}
        for r in sorted(seen.groupBy("lang", "c").agg(F.count("*").alias("n")).collect(), key=lambda r: (r.lang, -r.c)):
            if r.lang not in left and r.n > k:
                # More than k rows tie for the first place: about k of them, by a hash.
                least[r.lang], part[r.lang] = r.c, k / r.n
            left[r.lang] = left.get(r.lang, k) - r.n
            if left[r.lang] >= 0:
                least[r.lang] = r.c
        if not least:
            return []
        kept = seen.where(F.col("lang").isin(*least)).where(F.col("c") >= _by_language(least))
        if part:
            kept = kept.where(F.pmod(F.xxhash64("w"), F.lit(1_000_000)) < F.coalesce(_by_language(part), F.lit(1.0)) * 1_000_000)
        return kept.select("lang", "w", "c").collect()

    sums = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("c").alias("n")).collect()}
    langs = sorted(sums)
    seen_words, seen_grams = top(words.where("c > 1"), max_words), top(grams, max_grams)
    at = {x: i for i, x in enumerate(langs)}

    def rows(seen: list) -> tuple[dict, list]:
        index: dict[str, int] = {}
        out: list[np.ndarray] = []
        for r in sorted(seen, key=lambda r: (r.w, r.lang)):
            if r.lang in at:
                if r.w not in index:
                    index[r.w] = len(out)
                    out.append(np.zeros(len(langs)))
                out[index[r.w]][at[r.lang]] = r.c
        return index, out

    tables = []
    indexes = []
    for seen in (seen_words, seen_grams):
        index, counts = rows(seen)
        c = np.array(counts, dtype=float).reshape(len(counts), len(langs))
        each = np.array([sums[x] for x in langs], dtype=float) if langs else np.zeros(0)
        tables.append(np.log((c + 0.5) / (each + 1.0)) if len(c) else c)
        indexes.append(index)
    return {"langs": langs, "words": indexes[0], "grams": indexes[1], "word_rows": tables[0], "gram_rows": tables[1]}


def _by_language(values: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for lang in sorted(values) for x in (lang, values[lang])]), F.col("lang"))


class Scorer(dict):
    """word -> row of `rows`; an unseen word gets a row by backoff. Starts again from the known words when it grows too large."""

    def __init__(self, model: dict):
        super().__init__(model["words"])
        self.model = model
        self.n_known, self.n_langs = len(self), len(model["langs"])
        self.rows = np.zeros((self.n_known + CACHE, max(self.n_langs, 1)), dtype=np.float32)
        if self.n_known:
            self.rows[: self.n_known] = model["word_rows"]
        self.gram_rows = [tuple(x) for x in model["gram_rows"].tolist()]

    def backoff(self, marked: str) -> np.ndarray | float:
        """The mean row, over the ends in marked, of the longest known gram at each; 0 without any."""
        grams, rows = self.model["grams"], self.gram_rows
        found = []
        for end in range(2, len(marked) + 1):
            for n in ORDERS:
                if n <= end and (g := grams.get(marked[end - n : end])) is not None:
                    found.append(rows[g])
                    break
        return np.mean(found, axis=0) if found else 0.0

    def __missing__(self, word: str) -> int:
        k = len(self)
        self.rows[k] = self.backoff(f"_{word}_")
        self[word] = k
        return k

    def total(self, text: str) -> np.ndarray | None:
        """Each language's sum over the words of text; None without a letter."""
        words = LETTERS.findall(text.lower())
        if not words or not self.n_langs:
            return None
        total = np.zeros(self.n_langs)
        if len(max(words, key=len)) > LONG:
            known = self.model["words"]
            for run in (w for w in words if len(w) > LONG and w not in known):
                marked = f"_{run}_"
                for at in range(0, len(run), LONG):
                    # A slice begins with the letters before it that its first grams reach into.
                    total += self.backoff(marked[max(0, at - ORDERS[0] + 2) : at + LONG + 1])
            words = [w for w in words if len(w) <= LONG or w in known]
        for at in range(0, len(words), CACHE // 2):
            part = words[at : at + CACHE // 2]
            if len(self) + len(part) >= self.n_known + CACHE:
                self.clear()
                self.update(self.model["words"])
            total += self.rows[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(axis=0, dtype=np.float64)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        total = self.total(text) if text else None
        if total is None:
            return UNKNOWN, 0.0
        p = np.exp(total - total.max())
        best = int(total.argmax())
        return self.model["langs"][best], float(p[best] / p.sum())


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs plus lang_pred and score."""
    size = sum(len(k.encode()) + 80 for part in ("words", "grams") for k in model[part]) + model["word_rows"].nbytes + model["gram_rows"].nbytes
    shared = broadcast_value(docs.sparkSession, model, MODEL_BYTES, size, "language model")

    def make():
        return Scorer(shared.value).predict

    return add_columns(docs, [text], make, "lang_pred string, score double")


def keep_known(docs: DataFrame, model: dict, min_score: float = 0.5) -> DataFrame:
    """docs whose language is known well enough, with their own columns and lang as predicted."""
    cols = docs.columns
    found = predict(numbered(docs), model, text=f"d_{cols.index('text')}").where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return renamed(found, cols, {"lang": "lang_pred"})


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast(T.BinaryType())), F.lit(4)) == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs, ~held_out())
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
