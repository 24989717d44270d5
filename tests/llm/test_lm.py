import math
import re
import zlib
from collections import Counter

import numpy as np

from tracelode.llm import lm


def brute_tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), ""]


def test_query_against_plain_counts_and_on_held_out_texts(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/sf0.01/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = Counter(w for i, t in docs.items() if not held[i] for w in brute_tokens(t))
    n, v = sum(counts.values()), len(counts)
    rows = lm.op7_lm_scoring(spark, f"{data}/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = brute_tokens(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words), sum(counts[w] > 0 for w in words), n)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    outside = [r for r in rows if r.held_out]
    assert sum(r.score for r in outside) > sum(r.base_score for r in outside)


def test_small_head_gives_the_same_scores(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet").select("doc_id", "text")
    a, b = ({r.doc_id: r for r in lm.score(docs, lm.fit(docs.select("text"), growth=1.5, head=h)).collect()} for h in (100_000, 60))
    for i in a:
        assert a[i].n_known == b[i].n_known and abs(a[i].score - b[i].score) < 1e-6 * abs(a[i].score) and abs(a[i].base_score - b[i].base_score) < 1e-6 * abs(a[i].base_score)


def test_model_is_normalised_and_learns_context():
    rng = np.random.default_rng(0)
    pairs = np.zeros((6, 6))
    for h in range(6):
        pairs[h, (h + 1) % 6] = 500
        pairs[h] += rng.integers(1, 5, 6)
    log_p = lm.train_log_bilinear(pairs)
    assert np.allclose(np.exp(log_p).sum(axis=1), 1)
    assert (log_p.argmax(axis=1) == (np.arange(6) + 1) % 6).all()
    unigram = np.log(pairs.sum(axis=0) / pairs.sum())
    assert (pairs * log_p).sum() > (pairs * unigram).sum() + 0.5 * pairs.sum()


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "a B a", 3), (3, "a B a", 3), (4, "new words é", 4), (None, "a", 5), (6, "a " * 50_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    model = lm.fit(docs.where("doc_id = 3").select("text"))
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens) for r in lm.score(docs, model).collect())
    assert got == [(0, 2, 2, 8), (1, 1, 1, 8), (2, 1, 1, 8), (3, 4, 4, 8), (3, 4, 4, 8), (4, 4, 1, 8), (6, 50_001, 50_001, 8)]
    nothing = lm.fit(docs.limit(0).select("text"))
    assert {(r.n_known, r.train_tokens, r.base_score) for r in lm.score(docs, nothing).collect()} == {(0, 0, 0.0)}
    assert lm.score(docs.limit(0), model).count() == 0


def test_score_equals_the_definition(spark):
    """Every probability from plain counts and the class table, and all of them sum to 1 in any context."""
    texts = ["the cat sat on the mat", "a cat and a dog sat", "dogs and cats é été", "The dog ate the cats mat", "x y z sitting", ""] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = lm.fit(docs.select("text"), growth=1.2)
    counts = Counter(w for t in texts for w in brute_tokens(t))
    own = {w.decode(): c for w, c in zip(model["words"], model["class"].tolist()) if c > lm.SUFFIXES}
    assert 0 < len(own) < len(counts) - 1
    of = lambda w: lm.END_CLASS if w == "" else own.get(w) or lm.suffix_class(w.encode())
    rest = [w for w in counts if w and w not in own]
    once, twice = sum(counts[w] == 1 for w in rest), sum(counts[w] == 2 for w in rest)
    d = min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)
    share = d * len(rest) / sum(counts[w] for w in rest)

    def within(w):
        if w == "" or w in own:
            return 1.0
        mates = [x for x in rest if of(x) == of(w)]
        if w in counts:
            return (counts[w] - d) / sum(counts[x] - d for x in mates) * (1 - share)
        return share if mates else 1.0

    p = lambda h, w: 10 ** float(model["log_p"][of(h), of(w)]) * within(w)
    classes = {of(w) for w in counts}
    for h in ("", "the", "cat", "unheard"):
        seen = sum(p(h, w) for w in counts)
        unseen = sum(10 ** float(model["log_p"][of(h), k]) * (share if k in classes else 1.0) for k in range(1, lm.SUFFIXES + 1))
        assert abs(seen + unseen - 1) < 1e-5
    probes = ["the cat ate", "unheard words été", "", "x sitting bull a", "Z"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(probes)], "doc_id long, text string")
    for head in (100_000, 5):
        got = {r.doc_id: r.score for r in lm.score(table, lm.fit(docs.select("text"), growth=1.2, head=head)).collect()}
        for i, t in enumerate(probes):
            words = brute_tokens(t)
            assert abs(got[i] - sum(math.log10(p(h, w)) for h, w in zip(["", *words], words))) < 1e-5


def test_what_is_gathered_grows_with_the_corpus(spark):
    sizes = []
    for n in (50, 5000):
        docs = spark.range(n).selectExpr("concat_ws(' ', transform(sequence(1, 40), i -> concat('w', cast(pmod(xxhash64(id * 1000 + i), 3000) as string)))) text")
        sizes.append(len(lm.fit(docs, growth=20)["log_p"]))
    assert sizes[1] > sizes[0]


def test_many_classes_stay_under_the_bound_of_the_broadcast():
    """At as many classes as 1e12 tokens give, tables of all pairs would pass the bound; the factors are far below it."""
    n = int(10 * 1e12**0.25)
    assert n * n * 4 > lm.HEAD_BYTES
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, n * n, 50_000))
    model = lm.train_factors(keys, rng.integers(1, 9, len(keys)), n, steps=1)
    assert model.nbytes < lm.HEAD_BYTES / 20 and len(model) == n
    for h in (0, n // 2, n - 1):
        assert abs((10.0 ** model[np.full(n, h), np.arange(n)]).sum() - 1) < 1e-9


def test_blocks_of_rows_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 400, 150))
    counts = rng.integers(1, 50, len(keys))
    whole = lm.train_factors(keys, counts, 20)
    monkeypatch.setattr(lm, "row_blocks", lambda n: [(i, min(i + 3, n)) for i in range(0, n, 3)])
    cut = lm.train_factors(keys, counts, 20)
    a, b = np.repeat(np.arange(20), 20), np.tile(np.arange(20), 20)
    assert np.allclose(whole[a, b], cut[a, b], atol=1e-3)
    ids = rng.integers(0, 20, 5000)
    monkeypatch.setattr(lm, "PART", 7)
    assert abs(whole.total(ids) - whole[ids[:-1], ids[1:]].sum()) < 1e-6
    assert whole.total(ids[:1]) == 0.0


def test_pairs_are_counted_whatever_is_merged_when(monkeypatch):
    monkeypatch.setattr(lm, "PAIRS", 10)
    rng = np.random.default_rng(3)
    kept, want = lm.Pairs(), Counter()
    for _ in range(30):
        some = rng.integers(0, 40, rng.integers(0, 9))
        kept.add(some)
        want.update(some.tolist())
    assert dict(zip(*[c.to_pylist() for c in kept.batch().columns])) == dict(want)
