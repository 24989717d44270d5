import itertools
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tracelode.operators import phrases


def counts(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    return {r.phrase: r.occurrences for r in phrases.message_phrases(df, ["id"]).collect()}


def test_english_phrases_and_scaffolding(spark):
    got = counts(spark, "Please keep the change small. Keep the change small, see `x.rs` and https://a.b/c and /tmp/y ```code block here```")
    assert got["keep the change small"] == 2 and got["change small"] == 2
    assert not any("code" in p or "tmp" in p or "http" in p for p in got)
    assert "the change" in got and "please" not in got


def test_frames(spark):
    got = counts(spark, "Do you think this approach is right? 你是否觉得这个方案可以吗？")
    assert got["do you think…?"] == 1 and got["你觉得……吗"] == 1


def test_replays_and_limits(spark):
    rows = [(1, "user", 1, "run it"), (1, "user", 2, "run it"), (1, "assistant", 3, "ok"), (1, "user", 4, "now"), (1, "user", 5, "run it")]
    df = spark.createDataFrame(rows, "conv_id long, role string, turn long, text string")
    assert sorted(r.turn for r in phrases.without_replays(df, "conv_id", "turn").collect()) == [1, 3, 4, 5]
    many = spark.createDataFrame([("2026-01-01", r, f"phrase {i:03d}", i % 7 + 1) for r in ("user", "assistant") for i in range(400)], "date string, role string, phrase string, occurrences long")
    kept = phrases.daily_phrases(many, ["date", "role"]).groupBy("role").count().collect()
    assert {r.role: r["count"] for r in kept} == {"user": 240, "assistant": 240}


def test_cloud(spark):
    rows = [("s1", "user", "codex", "m1", "keep it small", 3), ("s2", "user", "codex", "m2", "keep it small", 1), ("s1", "user", "codex", "m1", "keep it", 3), ("s2", "user", "codex", "m1", "keep it", 1), ("s1", "user", "kimi", None, "only here", 9)]
    out = phrases.cloud(spark.createDataFrame(rows, "session_id string, role string, agent string, model string, phrase string, occurrences long")).collect()
    assert [(r.phrase, r.occurrences, r.sessions, r.dominant_model) for r in out] == [("keep it small", 4, 2, "m1")]


def test_a_phrase_inside_many_others_is_found_without_a_cap(spark):
    rows = [(s, "user", "codex", None, f"word{i} tail", 5) for i in range(900) for s in ("s1", "s2")] + [(s, "user", "codex", None, "tail", 6) for s in ("s1", "s2")]
    rows += [(s, "user", "codex", None, p, 1) for p in ("very rare phrase", "rare phrase") for s in ("s1", "s2")] + [(s, "user", "codex", None, p, 2) for p in ("运行测试", "行测试") for s in ("s1", "s2")]
    out = {r.phrase for r in phrases.cloud(spark.createDataFrame(rows, "session_id string, role string, agent string, model string, phrase string, occurrences long"), most=10_000).collect()}
    assert "tail" not in out and "very rare phrase" in out and "rare phrase" not in out and len(out) == 902
    assert "运行测试" in out and "行测试" not in out


def test_best_path_equals_trying_every_cut():
    rng = random.Random(1)
    for _ in range(60):
        run = "".join(rng.choice("项目运行") for _ in range(rng.randrange(1, 9)))
        lexicon = {"".join(rng.choice("项目运行") for _ in range(rng.randrange(1, 4))): -rng.random() * 9 for _ in range(8)}
        segmenter = phrases.Segmenter(lexicon)
        weigh = lambda words: sum(lexicon.get(w, segmenter.unknown if len(w) == 1 else -math.inf) for w in words)  # noqa: B023, E731
        cuts = [[run[a:b] for a, b in itertools.pairwise((0, *c, len(run)))] for n in range(len(run)) for c in itertools.combinations(range(1, len(run)), n)]
        assert math.isclose(weigh(segmenter(run)), max(map(weigh, cuts)))


def test_chinese_phrases_begin_at_every_character_or_at_words(spark):
    df = spark.createDataFrame([(1, "请运行测试项目")], "id long, text string")
    without = {r.phrase: r.segmentation for r in phrases.message_phrases(df, ["id"]).collect()}
    assert {"请运行", "运行测试", "行测试", "测试项目"} <= set(without) and set(without.values()) == {"fallback"}
    words = {"运行": -1.0, "测试": -1.0, "项目": -3.0, "请": -2.0}
    cut = {r.phrase: r.segmentation for r in phrases.message_phrases(df, ["id"], lexicon=words).collect()}
    assert {"运行测试", "请运行"} <= set(cut) and "行测试" not in cut and set(cut.values()) == {"lexicon"}


def test_counts_do_not_depend_on_how_many_a_task_holds(spark, monkeypatch):
    texts = spark.createDataFrame([("中文分词中文分 x 中文分词",), (None,), ("",), ("运行测试",)], "text string").coalesce(1)
    want = {"中文分": 3, "文分词": 2, "分词中": 1, "词中文": 1, "中文分词": 2, "文分词中": 1, "分词中文": 1, "词中文分": 1, "运行测": 1, "行测试": 1, "运行测试": 1}
    for held in (1, 100):
        monkeypatch.setattr(phrases, "PHRASES_AT_ONCE", held)
        monkeypatch.setattr(phrases, "MESSAGES_AT_ONCE", held)
        assert {r.phrase: r.occurrences for r in phrases.character_phrases(texts, 4).collect()} == want
        rows = spark.range(5).select("id", F.concat(F.lit("green apple pie number"), F.lit(" ok")).alias("text")).coalesce(1)
        found = phrases.message_phrases(rows, ["id"]).where("phrase = 'apple pie'").collect()
        assert sorted(r.id for r in found) == [0, 1, 2, 3, 4]


def test_all_phrases_of_long_messages_are_given(spark, monkeypatch):
    word = lambda i: "x" + "".join("abcdefghij"[int(d)] for d in f"{i:04d}")
    rows = [(k, " ".join(word(k * 1000 + i) for i in range(500))) for k in range(3)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    want = {(k, " ".join(word(k * 1000 + i + j) for j in range(n))): 1 for k in range(3) for n in range(2, 6) for i in range(500 - n + 1)}
    for held in (1, 700, 100_000):
        monkeypatch.setattr(phrases, "PHRASES_AT_ONCE", held)
        got = phrases.message_phrases(df, ["id"]).collect()
        assert len(got) == len(want) == 5970 and {(r.id, r.phrase): r.occurrences for r in got} == want
    assert {r["count"] for r in phrases.message_phrases(df, ["id"], most=180).groupBy("id").count().collect()} == {180}


def test_cloud_sums_all_phrases_once(spark):
    """Found is read for the sums and for what is shown of them, and no more; sessions, agents and models are those of a fold."""
    rng = random.Random(5)
    words = ["ab", "cd", "ef"]
    rows = [(rng.randrange(6), rng.choice("ua"), rng.choice(["x", "y", None]), rng.choice([None, "m", "n"]), " ".join(rng.choices(words, k=rng.randrange(1, 4))), rng.randrange(1, 9)) for _ in range(600)]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    schema = "session_id long, role string, agent string, model string, phrase string, occurrences long"
    out = phrases.cloud(spark.createDataFrame(rows, schema).mapInArrow(count, schema), most=7).collect()
    assert len(rows) < read.value <= 2 * len(rows)
    want = {}
    for role in "ua":
        mine = [r for r in rows if r[1] == role]
        sums, sessions = Counter(), {}
        for s, _, _, _, p, n in mine:
            sums[p] += n
            sessions.setdefault(p, set()).add(s)
        sums = {p: n for p, n in sums.items() if len(sessions[p]) >= 2}
        left = [p for p in sums if not any(f" {p} " in f" {q} " and p != q and sums[q] >= 0.8 * sums[p] for q in sums)]
        shown = sorted(left, key=lambda p: (-sums[p], -len(p), p))[:7]
        for rank, p in enumerate(shown, 1):
            best = []
            for k in (2, 3):
                by = Counter()
                for r in mine:
                    if r[4] == p and r[k] is not None:
                        by[r[k]] += r[5]
                best.append(min(by, key=lambda v: (-by[v], v)) if by else None)
            want[role, p] = (sums[p], len(sessions[p]), sums[p] / sums[shown[0]], *best, rank)
    assert {(r.role, r.phrase): tuple(r[2:]) for r in out} == want
