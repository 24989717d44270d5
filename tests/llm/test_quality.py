import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelode.llm import quality


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab é\n\t\x0b\x1c #|<", max_size=80)))
def test_features_equal_the_definitions(text):
    assert quality.measure(text)[:5] == quality.brute(text)


def test_em_finds_the_accuracies_of_hidden_votes():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.7
    accuracy, cover = [0.95, 0.9, 0.8, 0.7], [0.9, 0.5, 0.9, 0.4]
    votes = np.stack([np.where(rng.random(len(truth)) < c, np.where(rng.random(len(truth)) < a, truth, ~truth), -1) for a, c in zip(accuracy, cover)], axis=1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit([(tuple(map(int, p)), int(c)) for p, c in zip(patterns, counts)])
    assert abs(model["prior"] - 0.7) < 0.03
    for r, a in enumerate(accuracy):
        t = model["vote"][r]
        assert abs(t[1, 1] / (t[1, 0] + t[1, 1]) - a) < 0.04
    p = np.array([model["posterior"][tuple(map(int, v))] for v in votes])
    assert ((p > 0.5) == truth).mean() > 0.93


def test_verdicts_agree_with_labels(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/sf0.01/documents.parquet").collect()}
    rows = {r.doc_id: r for r in quality.op8_quality(spark, f"{data}/sf0.01").collect()}
    assert len(rows) == len(texts)
    for i, r in rows.items():
        want = quality.brute(texts[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    labels = [(r.quality, rows[r.doc_id]) for r in spark.read.parquet(f"{data}/sf0.01/labels.parquet").collect()]
    good = [r.kept for q, r in labels if q == 1 and not r.base_failed]
    bad = [r.kept for q, r in labels if q == 0]
    assert sum(good) / len(good) > 0.95
    assert sum(bad) / len(bad) < 0.3


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "word " * 60_000, "x"), (3, "word " * 60_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = quality.judge(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.kept) for r in out) == [(1, 0, False), (2, 0, False), (3, 60_000, False), (3, 60_000, False)]
    assert quality.judge(docs.limit(0)).count() == 0
