import math
import unicodedata
from collections import Counter, defaultdict

from tracelode.llm import langid


def test_held_out_accuracy(spark, data):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/sf0.001/documents.parquet").collect()}
    rows = langid.op2_language_id(spark, f"{data}/sf0.001").collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert 0.1 < len(held) / len(rows) < 0.45
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    rows = [(i, t, lang, "s") for i in range(1, 6) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.train(docs)
    probe = spark.createDataFrame([(1, None, None, "a"), (2, "", None, "a"), (3, "12 !?", None, "a"), (4, "the dog", None, "a"), (4, "the dog", None, "a"), (5, "hundekatze " * 30_000, None, "a")], docs.schema)
    got = sorted((r.doc_id, r.lang_pred) for r in langid.predict(probe, model).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")]
    kept = langid.keep_known(probe, model)
    assert kept.columns == probe.columns and sorted((r.doc_id, r.lang, r.score) for r in kept.collect()) == [(4, "en", "a"), (4, "en", "a"), (5, "de", "a")]
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(probe, nothing).collect()} == {"und"}
    assert langid.predict(probe.limit(0), model).count() == 0


def test_text_and_lang_alone_decide(spark):
    docs = spark.createDataFrame([(i, "uno dos tres" if i % 2 else "one two three", "es" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    a = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    b = {r.doc_id: r.lang_pred for r in langid.predict(docs.selectExpr("doc_id", "text", "'xx' lang"), model).collect()}
    assert a == b and set(a.values()) == {"en", "es"}


def brute(docs, probe):
    """Scores by the definition, in dictionaries; docs and probe are short enough for every word and gram to be in the model."""
    words, grams = defaultdict(Counter), defaultdict(Counter)
    split = lambda t: "".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower()).split()
    for text, lang in docs:
        words[lang].update(split(text))
    for lang, counts in words.items():
        for w, c in counts.items():
            for n in langid.ORDERS:
                for i in range(max(1, len(w) + 3 - n)):
                    grams[lang][f"_{w}_"[i : i + n]] += c
    langs = sorted(words)
    total = {x: sum(words[x].values()) for x in langs}
    row = lambda t, x: [math.log(((t[lang][x] if t[lang][x] > 1 else 0) + 0.5) / (total[lang] + 1)) for lang in langs]
    known = lambda t, x: any(t[lang][x] > 1 for lang in langs)
    sums = [0.0] * len(langs)
    for w in split(probe):
        rows = [row(words, w)] if known(words, w) else []
        if not rows:
            marked = f"_{w}_"
            for end in range(2, len(marked) + 1):
                rows += [row(grams, marked[end - n : end]) for n in langid.ORDERS if n <= end and known(grams, marked[end - n : end])][:1]
        for i in range(len(langs)):
            sums[i] += sum(r[i] for r in rows) / max(1, len(rows))
    best = max(range(len(langs)), key=lambda i: (sums[i], -i))
    return langs[best], 1 / sum(math.exp(x - sums[best]) for x in sums)


def test_scores_equal_the_definition(spark):
    docs = [("The cat sat on the mat, the cat.", "en"), ("the dog and the cat", "en"), ("Der Hund und die Katze und der Hund", "de"), ("le chat et le chien; le chat", "fr"), ("die Katze", "de"), ("et le chien", "fr")]
    table = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(docs)], "doc_id long, text string, lang string")
    probes = ["the", "die katzen", "chats et chiens", "catalogue", "hundert", "xyz", "le the der", "Ünder chéri"]
    got = langid.predict(spark.createDataFrame([(i, t) for i, t in enumerate(probes)], "doc_id long, text string"), langid.train(table)).collect()
    for r in got:
        lang, p = brute(docs, r.text)
        assert abs(r.score - p) < 1e-4 and (r.lang_pred == lang or p < 0.51), r


def test_letters_long_runs_ties_and_rare_languages(spark):
    rows = [(i, "abcabcabd abd", "aa", 0) for i in range(400)] + [(1000 + i, "xyzxyzxyw xyw", "bb", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, x int")
    model = langid.train(docs, max_train_docs=20)
    assert model["langs"] == ["aa", "bb"]
    probe = [(1, "½ ² ③ 12", "und"), (2, "q" * 5000 + "xyz" * 20_000, "bb"), (3, "xyz" * 20_000 + "abc" * 40_000, "aa"), (4, "xyw", "bb"), (5, "٣ ⅷ", "und")]
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame([x[:2] for x in probe], "doc_id long, text string"), model).collect()}
    assert got == {i: lang for i, _, lang in probe}
    # More words tie for the first place than the model may hold: some of them stay.
    many = spark.createDataFrame([(i, " ".join(f"w{chr(97 + i % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(200)), "aa") for i in (1, 1, 2, 2)], "doc_id long, text string, lang string")
    few = langid.train(many, max_words=40, max_grams=40)
    assert 10 < len(few["words"]) < 120
