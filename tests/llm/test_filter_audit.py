import math
import random
import re
from itertools import permutations

from tracelode.llm import filter_audit as fa

SCHEMA = "doc_id long, text string, source string, fails int, `same` string, `a.b` int"


def plain(docs, labels):
    """(part, order, step) -> counts, by applying the filters to the documents in every order."""
    smallest, marks = {}, {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    for i, q, t in labels:
        g, b = marks.get(i, (0, 0))
        marks[i] = (max(g, int(q == 1)), max(b, int(t == 1)))
    known = []
    for i, t, s in docs:
        text = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(w) < 50:
            fails.add("A")
        if 100 * len(set(w)) < 65 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if i is not None and smallest[text] < i:
            fails.add("E")
        known.append((s or "", fails, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    out = {}
    for part in {k[0] for k in known}:
        mine = [k for k in known if k[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in k[1]]
                left = [k for k in left if f not in k[1]]
                total[f] += len(gone)
                failing = sum(f in k[1] for k in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(k[1] == {f} for k in mine), sum(k[2] for k in gone), sum(k[3] for k in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*r, 7, "clash", 1) for r in docs], SCHEMA).repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = fa.order_report(fa.edge_report(fa.state_counts(fa.failures(d), marks))).collect()
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}


def sample(seed, n=150):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["w%d" % rng.randrange(80), "Ab", "é", "x\x0by", "日本", "#"] if rng.random() < 0.1 else ["w%d" % rng.randrange(60)]) for _ in range(rng.choice([10, 49, 50, 70, 90]))) for _ in range(40)]
    docs = [(rng.randrange(200), rng.choice(texts), rng.choice(["a", "b", None])) for _ in range(n)]
    docs += [(500, None, "a"), (501, "", "a"), (None, texts[0], "b"), (None, "", None), (502, "word " * 100_000, "b"), (3, "ONLY CAPS", "c"), (3, "ONLY CAPS", "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 180, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


def test_equals_applying_every_order(spark):
    docs, labels = sample(1)
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    docs, _ = sample(2, 5)
    assert audited(spark, docs, []) == plain(docs, [])


def test_paths_through_the_lattice():
    for k in range(1, 8):
        edges = fa.lattice_edges(k)
        assert len(edges) == k * 2 ** (k - 1)
        for size in range(k):
            assert sum(o for s, _, o in edges if s.bit_count() == size) == math.factorial(k)
        assert all(o == math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count()) for s, _, o in edges)


def test_shapley_figures_add_up_to_what_all_orders_remove(spark):
    docs, labels = sample(3)
    rows = audited(spark, docs, labels)
    for part in {p for p, _, _ in rows}:
        steps = {order: [rows[part, order, s] for s in range(1, 6)] for p, order, s in rows if p == part}
        assert sum(r[6] for r in steps["ABCDE"]) == 120 * sum(r[1] for r in steps["ABCDE"])
        assert len({r[-1][0] for r in steps.values()}) == 1
