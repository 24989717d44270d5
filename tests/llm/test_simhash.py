import random
import re

import xxhash

from tracelode.llm import simhash


def brute_fp(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, distance=2):
    """(id, fp) -> smallest id reachable."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if i < j and (a ^ b).bit_count() <= distance:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in rows}


def test_links_against_brute_force_with_hot_keys(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(30)]
    hub = rng.getrandbits(64)
    chain = [hub]
    for _ in range(40):
        chain.append(chain[-1] ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20, 64)))
    near = [hub ^ (1 << i) for i in range(64)] + [hub ^ (1 << rng.randrange(8)) ^ (1 << rng.randrange(60, 64)) for _ in range(60)]
    rows = list(enumerate([0, 1 << 63, *fps, *chain, *near]))
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in rows]
    df = spark.createDataFrame(rows, "doc_id long, fp long").groupBy("fp").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "doc_id")
    want = brute_components([(i, f % (1 << 64)) for i, f in rows])
    for bucket in (2, 1000):
        roots = {r.node: r.root for r in simhash.components(simhash.close_links(df.select("fp"), bucket=bucket)).collect()}
        groups, wanted = {}, {}
        for i, f in rows:
            groups.setdefault(roots.get(f, f), set()).add(i)
            wanted.setdefault(want[i], set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_long_chain_settles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.limit(0)).count() == 0


def test_query_equals_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/sf0.001/documents.parquet").collect()]
    fps = [(i, brute_fp(t)) for i, t in docs]
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash(spark, f"{data}/sf0.001").collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in fps}


def test_edge_rows(spark):
    rows = [(3, None, "x"), (2, "", "x"), (7, " \n", "x"), (5, "Two words", "x"), (5, "Two words", "x"), (9, "two  WORDS", None), (8, "a b c d e " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id, r.component_id) for r in simhash.simhash_components(docs).collect())
    assert got == [(2, 2), (3, 2), (5, 5), (5, 5), (7, 2), (8, 8), (9, 5)]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect())[-1] == 8 and 3 not in {r.doc_id for r in kept.collect()}
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    assert simhash.fingerprint("É a b") == simhash.fingerprint("É A  B") and brute_fp("x " * 900) == simhash.fingerprint("x " * 900) % (1 << 64)


def test_near_copies_are_found_and_others_stay(spark):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "tu") for b in ("ra", "so", "ti", "va", "we") for c in ("n", "r", "s", "t", "x", "")]
    rows, want = [], {}
    for base in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(120, 400))]
        for copy in range(4):
            edited = list(words)
            for i in rng.sample(range(len(words)), copy * len(words) // 200):
                edited[i] = rng.choice(vocabulary)
            rows.append((base * 10 + copy, " ".join(edited), "s"))
            want[base * 10 + copy] = base * 10
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()}
    assert sum(got[i] == want[i] for i in want) / len(want) > 0.95
    assert all(got[i] // 10 == i // 10 for i in got)


def test_shingle_verification_is_exact(spark):
    a = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, a), (2, " ".join(reversed(a.split()))), (3, a.upper())], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_components(docs).collect()) == [(1, 1), (2, 2), (3, 1)]


def jaccard(a, b, size=5):
    x, y = ({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_texts_with_words_added_or_cut_are_found(spark):
    rng = random.Random(3)
    rows = []
    for base in range(24):
        words = [f"w{rng.randrange(30_000)}" for _ in range(rng.choice((160, 600, 1500)))]
        n = len(words) - 4
        tail = [f"w{rng.randrange(30_000)}" for _ in range(int(n * 0.245))]
        rows += [(base * 10, " ".join(words)), (base * 10 + 1, " ".join(words + tail)), (base * 10 + 2, " ".join(words[: len(words) - int(n * 0.195)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    assert all(0.8 <= jaccard(text[i], text[i - i % 10]) < 0.82 for i in text if i % 10)
    assert {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()} == {i: i - i % 10 for i in text}


def test_large_keys_leave_no_pair_out(spark, monkeypatch):
    rng = random.Random(8)
    form, rows = [f"form{i}" for i in range(120)], []
    for base in range(80):
        body = [f"w{rng.randrange(900)}" for _ in range(80)]
        changed = list(body)
        changed[40] = "changed"
        rows += [(base * 10, " ".join(form + body)), (base * 10 + 1, " ".join(form + changed))]
    # The same words in other orders: alike by words, not by shingles.
    for base in range(80, 160):
        words = rng.sample(form, len(form))
        rows += [(base * 10, " ".join(words)), (base * 10 + 1, " ".join([*words, "more"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: i - i % 10 for i, _ in rows}
    for kept in (simhash.ORDER_SHINGLES, 0):
        # Without an order of shingles the form's own ones become keys of 160 texts.
        monkeypatch.setattr(simhash, "ORDER_SHINGLES", kept)
        assert {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()} == want


def test_rows_without_or_with_one_doc_id_stay_unless_copies(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(9_000)}" for _ in range(60)) for _ in range(6)]
    rows = [(None, texts[0], "a"), (None, texts[1], "a"), (None, texts[1] + " more", "b"), (1, texts[2], "a"), (1, texts[3], "a"), (1, texts[3], "a"), (None, texts[3], "a"), (2, texts[4], "a"), (1, texts[4] + " more", "b"), (3, texts[5], "a"), (None, texts[5] + " more", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [(r.doc_id, r.text, r.source) for r in simhash.drop_near_duplicates(docs).collect()]
    second = [x for x in kept if x[0] is None and x[1].startswith(texts[1])]
    assert len(second) == 1
    assert sorted((x for x in kept if x not in second), key=str) == sorted([rows[0], rows[3], rows[4], rows[8], rows[9]], key=str)
