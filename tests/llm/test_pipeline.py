"""The pipeline against a plain version of each stage on the small tables."""

from collections import Counter, defaultdict

import sentencepiece

import corpus_pipeline
from tests.llm.test_decontam import brute as windows_hit
from tracelode.llm import pieces, pii

SIZE, SIMILARITY = 5, 0.8


def groups(docs):
    """Smallest id of each document's group: exhaustive shingle sets, union of pairs at similarity 0.8."""
    sets, where, root = {}, defaultdict(list), {i: i for i in docs}
    for i, t in docs.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + SIZE]) for k in range(max(1, len(w) - SIZE + 1))} if w else set()
        for s in sets[i]:
            where[s].append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    shared = Counter((a, b) for ids in where.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    for (a, b), n in shared.items():
        if n >= SIMILARITY * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in docs}


def test_pipeline_equals_plain_stages(spark, data):
    folder = f"{data}/sf0.001"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in table.collect()}
    lang = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, table, folder).collect()}
    assert len(lang) == len(rows) and sum(lang[i] == rows[i].lang for i in rows) / len(rows) > 0.95
    group = groups({i: rows[i].text for i in lang})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = [(i, rows[i].text) for i in lang if group[i] == i]
    clean = {i for i, _, hit, _ in windows_hit(kept, items) if not hit}
    find, library = pii.finder(), sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = {}
    for i in clean:
        out, at, text = [], 0, rows[i].text
        for s, k, e in find(text):
            if s >= at:
                out += [text[at:s], f"[{pii.KINDS[k].upper()}]"]
            at = max(at, e)
        want[i] = library.encode("".join([*out, text[at:]]))
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got.keys() == want.keys()
    assert got == want


def test_stages_keep_the_columns_of_documents(spark, data):
    folder = f"{data}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert [(f.name, f.dataType) for f in out.schema.fields] == [(f.name, f.dataType) for f in docs.schema.fields], name


def test_empty_documents(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
