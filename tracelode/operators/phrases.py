"""Phrase mining: prompts are cleaned and framed in expressions, tokenised and counted in an Arrow map, ranked in windows.

With a lexicon, Chinese runs are cut along the most probable path of the lattice of its words; without one, every run of
characters that is long enough is a phrase. `segmentation` tells which it was; English follows its tokens exactly.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tracelode.functions.hashing import stable_hash
from tracelode.operators.graph import kept

# Bounds.
MAX_TOKENS, MAX_PER_ROLE_DATE, MAX_CLOUD = 5, 240, 8
ZH_CHARS, EN_TOKENS, EN_BYTES, ZH_TOKEN, EN_TOKEN = (3, 12), (2, 5), 72, 12, 28

#: Messages, and phrases of counted texts, that a task holds as Python values at once; the phrases of one text may be more.
MESSAGES_AT_ONCE, PHRASES_AT_ONCE = 64, 100_000
#: Words of a lexicon that may be sent to every task.
LEXICON_WORDS = 1_000_000

# What is removed from a prompt, in this order.
REMOVED = (
    r"(?ims)^\s*#\s*Files mentioned by the user:\s*.*?^\s*##\s*My request for Codex:\s*",
    r"(?im)^\s*#{1,6}\s*My request for Codex:\s*$",
    r"(?s)```.*?```",
    r"`[^`\r\n]+`",
    r"(?i)\b(?:https?|file)://\S+",
    r"(?:^|\s)(?:~?/|[A-Za-z]:\\)[^\s，。！？；：,.!?;:]+",
    r"""(?i)\b(?:api[_-]?key|access[_-]?token|secret|password|authorization)\b\s*[:=]\s*["']?\S+""",
    r"\b[A-Za-z0-9_+/=-]{28,}\b",
    r"(?s)<[^>]{1,240}>",
)
# Question frames.
ZH_FRAME = r"你(?:是否)?(\p{IsHan}{2})([^。！？!?\n]{1,48})吗\s*[？?]?"
EN_FRAME = r"(?i)\b(?:do|would|will|can)\s+you\s+([a-z]{3,16})\b[^.!?\n]{1,80}\?"
# Words that carry no phrase alone.
EN_STOP = frozenset((
    "a", "about", "after", "again", "all", "also", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "but",
    "by", "can", "code", "could", "did", "do", "does", "doing", "done", "each", "file", "files", "for", "from", "get", "got", "had", "has", "have",
    "here", "how", "i", "if", "in", "into", "is", "it", "its", "just", "let", "like", "may", "me", "more", "most", "my", "need", "no", "not", "now",
    "of", "on", "one", "only", "or", "our", "out", "please", "project", "same", "session", "should", "so", "some", "than", "that", "the", "their",
    "them", "then", "there", "these", "they", "this", "those", "to", "tool", "up", "use", "used", "using", "very", "want", "was", "we", "were",
    "what", "when", "where", "which", "who", "why", "will", "with", "would", "you", "your",
))
ZH_STOP = frozenset((
    "一个", "一些", "以及", "但是", "不是", "不要", "不能", "不过", "为什么", "为了", "之前", "之后", "他们", "你们", "使用", "可以", "可能", "同时", "因为", "如果", "它们", "对于", "已经", "应该",
    "怎么", "我们", "或者", "所以", "文件", "是否", "有些", "没有", "然后", "现在", "用户", "项目", "代码", "自己", "这个", "这些", "这里", "这样", "那个", "那些", "还是", "进行", "通过", "需要",
))

PART = re.compile(r"[㐀-䶿一-鿿]+|[^\s㐀-䶿一-鿿]+")
HAN = re.compile(r"[㐀-䶿一-鿿]+\Z")
LATIN = re.compile(r"[A-Za-z'-]+\Z")


def cleaned(c: Column) -> Column:
    for pattern in REMOVED:
        c = F.regexp_replace(c, pattern, " ")
    return c


def frames(c: Column) -> Column:
    """Question frames of a cleaned prompt, one entry an occurrence."""
    zh = F.transform(F.regexp_extract_all(c, F.lit(ZH_FRAME), F.lit(1)), lambda v: F.concat(F.lit("你"), v, F.lit("……吗")))
    rest = F.regexp_replace(c, ZH_FRAME, " ")
    en = F.transform(F.regexp_extract_all(rest, F.lit(EN_FRAME), F.lit(1)), lambda v: F.concat(F.lit("do you "), F.lower(v), F.lit("…?")))
    return F.concat(zh, en)


def unframed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, ZH_FRAME, " "), EN_FRAME, " ")


def _token(raw: str) -> tuple[str, str, bool] | None:
    """(text, script, stop word), or None for what ends a segment."""
    t = raw
    while t and not (t[0].isalnum() or t[0] in "-'"):
        t = t[1:]
    while t and not (t[-1].isalnum() or t[-1] in "-'"):
        t = t[:-1]
    if HAN.match(t):
        return (t, "zh", t in ZH_STOP) if len(t) <= ZH_TOKEN else None
    if LATIN.match(t) and any(c.isalpha() for c in t) and len(t) <= EN_TOKEN:
        return t.lower(), "en", t.lower() in EN_STOP
    return None


def best_path(run: str, lexicon: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The words of run with the largest sum of weights; a character that no word covers weighs `unknown`. Of equal paths the one whose last words are longer."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        options = []
        for size in range(1, min(longest, end) + 1):
            weight = lexicon.get(run[end - size : end])
            if weight is not None or size == 1:
                options.append((best[end - size][0] + (unknown if weight is None else weight), size))
        best.append(max(options))
    out, at = [], len(run)
    while at:
        out.append(run[at - best[at][1] : at])
        at -= best[at][1]
    return out[::-1]


class Segmenter:
    """Words of Chinese runs by a lexicon: word -> weight, the logarithm of its probability."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = {w: v for w, v in lexicon.items() if w}
        self.longest = max(map(len, self.lexicon), default=1)
        # An unknown character costs more than any known word.
        self.unknown = min(self.lexicon.values(), default=0.0) - 1.0

    def __call__(self, run: str) -> list[str]:
        return best_path(run, self.lexicon, self.longest, self.unknown)


def characters(run: str, longest: int = ZH_CHARS[1]) -> Counter:
    """Every run of characters inside run that is as long as a phrase may be, but words that carry none alone."""
    found = (run[i : i + n] for n in range(ZH_CHARS[0], longest + 1) for i in range(len(run) - n + 1))
    return Counter(p for p in found if p not in ZH_STOP)


def character_phrases(texts: DataFrame, longest: int, text: str = "text") -> DataFrame:
    """(phrase, occurrences) of the Chinese runs of all texts, phrases of up to `longest` characters.

    A task adds up what it has counted and hands it on when it holds PHRASES_AT_ONCE phrases; a text is counted on its own.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        given = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["phrase", "occurrences"])
        for batch in batches:
            for t in batch.column(0):
                for run in PART.findall(t.as_py() or ""):
                    if HAN.match(run):
                        counts.update(characters(run, longest))
                if len(counts) >= PHRASES_AT_ONCE:
                    yield given()
                    counts.clear()
        yield given()

    found = texts.select(text).mapInArrow(count, "phrase string, occurrences long")
    return found.groupBy("phrase").agg(F.sum("occurrences").alias("occurrences"))


def ngrams(text: str, segmenter: Segmenter | None = None) -> Counter:
    """Phrases of one message with their occurrences."""
    counts: Counter = Counter()
    segment: list[tuple[str, str, bool]] = []

    def close() -> None:
        for i in range(len(segment)):
            for n in range(1, MAX_TOKENS + 1):
                part = segment[i : i + n]
                if len(part) < n:
                    break
                if all(stop for _, _, stop in part):
                    continue
                words = [w for w, _, _ in part]
                if part[0][1] == "zh":
                    phrase = "".join(words)
                    good = ZH_CHARS[0] <= len(phrase) <= ZH_CHARS[1]
                else:
                    phrase = " ".join(words)
                    good = EN_TOKENS[0] <= n <= EN_TOKENS[1] and len(phrase.encode()) <= EN_BYTES
                if good:
                    counts[phrase] += 1
        segment.clear()

    for raw in PART.findall(text):
        if segmenter is None and HAN.match(raw):
            close()
            counts.update(characters(raw))
            continue
        for piece in segmenter(raw) if HAN.match(raw) else [raw]:
            token = _token(piece)
            if token is None or (segment and segment[-1][1] != token[1]):
                close()
            if token is not None:
                segment.append(token)
                if not piece[-1].isalnum() and piece[-1] not in "-'":
                    close()
    close()
    return counts


def message_phrases(messages: DataFrame, key: list[str], text: str = "text", lexicon: dict[str, float] | None = None, most: int | None = None) -> DataFrame:
    """(key, phrase, occurrences): the phrases of each message; all of them, or the `most` frequent, then long ones.

    lexicon: Chinese words with their weights, at most LEXICON_WORDS, as they go to every task.
    """
    if lexicon is not None and len(lexicon) > LEXICON_WORDS:
        raise ValueError(f"a lexicon of {len(lexicon)} words is too large to send to every task")
    shared = None if lexicon is None else messages.sparkSession.sparkContext.broadcast(lexicon)
    ready = messages.withColumn("__c", cleaned(F.trim(text))).where(F.length(F.trim(text)) >= 2)
    ready = ready.select(*key, frames(F.col("__c")).alias("__f"), unframed(F.col("__c")).alias("__t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = None if shared is None else Segmenter(shared.value)
        for whole in batches:
            # A few messages at a time: neither texts nor phrases of a whole batch become Python values at once.
            for at in range(0, whole.num_rows, MESSAGES_AT_ONCE):
                batch = whole.slice(at, MESSAGES_AT_ONCE)
                rows, phrases, occurrences = [], [], []

                def given() -> pa.RecordBatch:
                    keys = batch.select(key).take(pa.array(rows, pa.int64()))  # noqa: B023
                    return pa.RecordBatch.from_arrays([*keys.columns, pa.array(phrases, pa.string()), pa.array(occurrences, pa.int64())], names=[*key, "phrase", "occurrences"])  # noqa: B023

                for i, (fs, t) in enumerate(zip(batch.column("__f").to_pylist(), batch.column("__t").to_pylist())):
                    counts = ngrams(t, segmenter)
                    counts.update(fs)
                    found = counts.items() if most is None else heapq.nsmallest(most, counts.items(), key=lambda x: (-x[1], -len(x[0]), x[0]))
                    for p, n in found:
                        rows.append(i)
                        phrases.append(p)
                        occurrences.append(n)
                    # A text is counted on its own; what many long ones give does not wait for the last of them.
                    if len(rows) >= PHRASES_AT_ONCE:
                        yield given()
                        rows, phrases, occurrences = [], [], []
                yield given()

    out = StructType([*[ready.schema[k] for k in key], StructField("phrase", StringType()), StructField("occurrences", LongType())])
    return ready.mapInArrow(count, out).select(*key, "phrase", "occurrences", F.when(F.col("phrase").rlike(r"\p{IsHan}"), "fallback" if lexicon is None else "lexicon").otherwise("exact").alias("segmentation"))


def without_replays(messages: DataFrame, session: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """Messages that do not repeat the one before of the same role."""
    f = stable_hash(F.col(text))
    w = Window.partitionBy(session, role).orderBy(order)
    return messages.withColumn("__f", f).withColumn("__b", F.lag("__f").over(w)).where(F.col("__b").isNull() | (F.col("__f") != F.col("__b"))).drop("__f", "__b")


def daily_phrases(found: DataFrame, key: list[str]) -> DataFrame:
    """Occurrences by (key, phrase) with the MAX_PER_ROLE_DATE best of each key: occurrences, then length, then text."""
    sums = found.groupBy(*key, "phrase").agg(F.sum("occurrences").alias("occurrences"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("occurrences"), F.desc(F.length("phrase")), F.asc("phrase")))
    return sums.withColumn("rank", rank).where(F.col("rank") <= MAX_PER_ROLE_DATE)


def parts_of(phrase: Column) -> Column:
    """The shorter phrases inside a phrase: runs of its words, or of its characters where it is Chinese."""
    han = phrase.rlike(r"\p{IsHan}") & ~phrase.contains(" ")
    tokens = F.when(han, F.split(phrase, "")).otherwise(F.split(phrase, " "))
    tokens = F.filter(tokens, lambda x: x != "")
    joined = lambda i, n: F.when(han, F.array_join(F.slice(tokens, i, n), "")).otherwise(F.array_join(F.slice(tokens, i, n), " "))
    size = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: joined(i, n)))
    return F.array_remove(F.array_distinct(F.flatten(runs)), phrase)


def cloud(found: DataFrame, minimum_sessions: int = 2, most: int = MAX_CLOUD, share: float = 0.8) -> DataFrame:
    """Per role the phrases of two or more sessions, with weight, dominant agent and model, without those inside a longer one.

    found: session_id, role, agent, model, phrase, occurrences. Decisions: weight is occurrences over the role's
    largest; a phrase goes if a longer one of the role holds it with at least `share` of its occurrences. Each phrase names
    the phrases inside it and they meet by equality, so all phrases take part; tasks hand on the first of each role.
    Of all phrases only sums go through a shuffle (two sessions are a least and a largest one that differ); sessions, agents and
    models are counted in a second pass over found, for the phrases that are shown.
    """
    by = ["role", "phrase"]
    several = F.col("low") != F.col("high") if minimum_sessions == 2 else F.col("sessions") >= minimum_sessions
    seen = [F.min("session_id").alias("low"), F.max("session_id").alias("high")] if minimum_sessions == 2 else [F.count_distinct("session_id").alias("sessions")]
    sums = found.groupBy(*by).agg(F.sum("occurrences").alias("occurrences"), *seen).where(several).select(*by, "occurrences")
    # One read of the sums: each gives its own row and one for each phrase inside it.
    none = F.lit(None).cast("long")
    own = F.array(F.struct("phrase", F.col("occurrences").alias("own"), none.alias("longer")))
    inside = F.transform(parts_of(F.col("phrase")), lambda p: F.struct(p.alias("phrase"), none.alias("own"), F.col("occurrences").alias("longer")))
    both = sums.select("role", F.inline(F.coalesce(F.concat(own, inside), own))).groupBy(*by).agg(F.max("own").alias("occurrences"), F.max("longer").alias("longer"))
    left = both.where(F.col("occurrences").isNotNull() & F.coalesce(F.col("longer") < share * F.col("occurrences"), F.lit(True)))
    best = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("occurrences"), F.desc(F.length("phrase")), F.asc("phrase")))
    final = kept(left.withColumn("rank", best).where(F.col("rank") <= most).select(*by, "occurrences", "rank"), "cloud")

    # A role and a rank are a phrase; each row of found counts for its session, its agent and its model.
    shown, at = final.select(F.col("role").alias("r"), F.col("phrase").alias("p"), "rank"), ["r", "rank"]
    values = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("v")) for k, c in enumerate(("session_id", "agent", "model"))])
    met = found.join(shown, F.col("role").eqNullSafe(F.col("r")) & (F.col("phrase") == F.col("p"))).select(*at, "occurrences", F.inline(values)).where("v IS NOT NULL")
    n = met.groupBy(*at, "kind", "v").agg(F.sum("occurrences").alias("n"))
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct((-F.col("n")).alias("n"), "v"))).getField("v")
    told = n.groupBy(*at).agg(F.count_if(F.col("kind") == 0).alias("sessions"), first(1).alias("dominant_agent"), first(2).alias("dominant_model")).withColumnRenamed("rank", "q")
    weight = F.col("occurrences") / F.max("occurrences").over(Window.partitionBy("role"))
    out = final.join(told, F.col("role").eqNullSafe(F.col("r")) & (F.col("rank") == F.col("q")), "left")
    return out.select(*by, "occurrences", F.coalesce("sessions", F.lit(0)).alias("sessions"), weight.alias("weight"), "dominant_agent", "dominant_model", "rank")
