"""What the stages and operators do with columns of any name, and with all characters."""

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tracelode.llm import decontam, langid, pieces, pii, quality, simhash

ODD = ("key", "row", "__raw", "near_digest", "near_id", "a.b", "node", "digest", "hit", "d_0", "c d", "ids2", "lang_pred", "clean")


@pytest.fixture(scope="module")
def docs(spark, data):
    own = spark.read.parquet(f"{data}/sf0.001/documents.parquet").limit(60)
    return own.select("*", *[F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in ODD])


def untouched(df):
    rows = df.select("doc_id", *[f"`{c}`" for c in ODD if c in df.columns]).collect()
    assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in r.asDict() if c != "doc_id")


@pytest.mark.parametrize("stage", ["language", "near", "decontaminate", "redact"])
def test_stages_keep_columns_of_any_name(spark, data, docs, stage):
    out = {
        "language": lambda: langid.keep_known(docs, langid.train(docs)),
        "near": lambda: simhash.drop_near_duplicates(docs),
        "decontaminate": lambda: decontam.drop_contaminated(docs, spark.read.parquet(f"{data}/sf0.001/benchmark.parquet")),
        "redact": lambda: pii.redact_pii(docs),
    }[stage]()
    assert out.columns == docs.columns
    untouched(out)


def test_operators_keep_columns_of_any_name(spark, docs):
    long = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.repeat("text", 300)).otherwise(F.col("text")))
    for df in (long, long.repartition(3)):
        encoded = pieces.encode(df, pieces.default_model())
        assert encoded.columns == [*docs.columns, "ids"]
        untouched(encoded)
    untouched(pieces.decode(pieces.encode(docs, pieces.default_model()), pieces.default_model()))
    untouched(quality.judge(docs))


def test_all_characters_are_encoded(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and c != 0x2581]
    texts = ["".join(every[i : i + 4000]) for i in range(0, len(every), 4000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.ids for r in pieces.encode(rows, pieces.default_model()).collect()}
    sample = range(0, len(texts), 9)
    assert len(got) == len(texts) and all(got[i] == model.encode(texts[i]) for i in sample)
