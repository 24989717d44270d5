import re

from tracelode.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, size=10):
    split = lambda t: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((doc, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


LONG = " ".join(f"w{i % 37}" for i in range(400))
ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item."), (3, None), (4, "?!"), (5, "one two three four five six seven eight nine ten"), (6, "short  ITEM"), (7, " ".join(f"w{i}" for i in range(30, 37)) + " w0 w1 w2")]
DOCS = [(1, "Zero ONE, two three-four five six seven eight nine ten eleven twelve thirteen"), (2, None), (3, ""), (4, "a short item; and a short item"), (5, LONG), (5, LONG), (6, "item short item"), (7, "é one")]


def frames(spark):
    docs = spark.createDataFrame([(*r, "x") for r in DOCS], "doc_id long, text string, hit string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_equals_brute_force_in_one_block_and_in_many(spark):
    docs, items = frames(spark)
    want = brute(DOCS, ITEMS)
    for block in (decontam.BLOCK_BYTES, 3000):
        rows = decontam.find_windows(docs, items, block_bytes=block).select("doc_id", "n_words", "hit", "items").collect()
        assert sorted([tuple(r) for r in rows], key=repr) == want


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert decontam.find_windows(docs.limit(0), items).count() == 0
    assert {len(r.hit) for r in decontam.find_windows(docs, items.limit(0)).collect()} == {0}


def test_filter_keeps_columns_and_clean_documents(spark):
    docs, items = frames(spark)
    out = decontam.drop_contaminated(docs, items)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 7]
