import random
import re
from collections import Counter, defaultdict

from tracelode.llm import collocations as co

SCHEMA = "text string, lang string, doc_id long, `next` string, `a.b` int"


def plain(rows, least, most_words=5, share=100, per_lang=2000):
    """lang -> ranked (phrase, a, l, r, n, score) by counting every phrase."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, most_words + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = {}
    for lang, c in counts.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i : i + m]] = max(longest[p[i : i + m]], a)
        rows = []
        for p, a in cand.items():
            if 100 * longest[p] >= share * a:
                continue
            score, _, l, r = min((1000 * a * totals[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((" ".join(p), a, l, r, totals[lang], score))
        if rows:
            out[lang] = sorted(rows, key=lambda x: (-x[5], -x[1], x[0].encode()))[:per_lang]
    return out


def mined(spark, rows, least, share=100, per_lang=2000, bits=co.MOST_BITS):
    docs = spark.createDataFrame([(t, l, i, "clash", 1) for i, (t, l) in enumerate(rows)], SCHEMA).repartition(5)
    totals, found = co.count_phrases(docs, least, most_bits=bits)
    out = defaultdict(dict)
    for r in co.top_phrases(co.mine(totals, found, share), per_lang).collect():
        out[r["lang"]][r["rank"]] = (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"])
    return {lang: [ranks[i] for i in range(1, len(ranks) + 1)] for lang, ranks in out.items()}


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["A", "the", "b", "é", "of", " ", "c|d", "日本", "E", "f", "Zz", "\x1f"]
    marks = [" ", "  ", "\t", " ", " ", ", ", "\n", ".", "\x0b"]
    rows = [("".join(rng.choice(words[: rng.choice([3, 12])]) + rng.choice(marks) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None, "und"])) for _ in range(n)]
    return rows + [("one two three four five six " * 12, "en")] * 3 + [(None, "en"), ("", None), (" .,\t", "fr"), ("same phrase. " * 40, "de")]


def test_equals_counting_every_phrase(spark):
    rows = texts(1)
    for least, share in ((5, 100), (12, 60)):
        want = plain(rows, least, share=share)
        assert want and mined(spark, rows, least, share) == want


def test_a_full_bitmap_only_prunes_less(spark):
    rows = texts(2, 60)
    assert mined(spark, rows, 4, bits=1 << 16) == plain(rows, 4)


def test_ranks_stop_at_the_limit_and_keep_the_order(spark):
    rows = texts(3, 60)
    assert mined(spark, rows, 3, per_lang=7) == plain(rows, 3, per_lang=7)


def test_empty_tables_and_tables_without_frequent_phrases(spark):
    assert mined(spark, [], 3) == {}
    assert mined(spark, [("alone here", "en"), (None, None)], 3) == {}


def test_blocks_cut_no_phrase(monkeypatch):
    text = ("a b c d e f, " * 30 + "x" * 90 + " a b\tc " * 20).encode()
    texts = (text, b"a b", b"c d e", text)
    monkeypatch.setattr(co, "BLOCK", 16)
    every = co.np.full(1 << 10, 2**64 - 1, co.np.uint64)

    def counted(tokens, k):
        monkeypatch.setattr(co, "TOKENS", tokens)
        total, block = Counter(), co._Block("en", 5)
        rows = [r for t in texts for r in block.add(t)] + list(block.flush())
        assert tokens > 100 or len(rows) > 20
        for lang, names, ids, carried in rows:
            found = co._Counted(lang, names, ids, carried, k, every)
            for batch in co._stripe_rows(found, lang, every):
                for r in batch.to_pylist():
                    words = r["nexts"].split(" ")
                    for w, n in zip(words, r["counts"].split(" ") if r["counts"] else ["1"] * len(words)):
                        total[r["prefix"], w] += int(n)
        return total

    for k in (1, 2, 3, 5):
        want = Counter()
        for t in texts:
            for piece in t.decode().split(","):
                w = piece.split()
                want.update((" ".join(w[i : i + k - 1]), w[i + k - 1]) for i in range(len(w) - k + 1))
        if k == 1:
            want[None, ""] = sum(want.values())
        assert counted(10**6, k) == want
        assert counted(9, k) == want


def test_hot_prefixes_are_dealt_and_add_up(spark):
    rows = texts(4, 60)
    docs = spark.createDataFrame([(t, l, 0, "", 1) for t, l in rows], SCHEMA)
    lists = [sorted(map(tuple, co.count_phrases(docs, 3, hot=hot)[1].collect())) for hot in (1, 10**9)]
    assert lists[0] == lists[1]


def test_scores_beyond_64_bits_are_exact(spark):
    big = 3 * 10**12
    totals = spark.createDataFrame([("en", 4 * big + 1)], "lang string, n long")
    found = spark.createDataFrame(
        [("en", 1, "", "x", "x", big + 7), ("en", 1, "", "y", "y", big + 1), ("en", 2, "x", "y", "x y", big - 3)],
        "lang string, k int, prefix string, next string, phrase string, f long",
    )
    r = co.mine(totals, found).first()
    assert r.score == 1000 * (big - 3) * (4 * big + 1) // ((big + 7) * (big + 1))
