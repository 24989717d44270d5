import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracelode.llm import token_files as tf
from tracelode.llm.common import shared_path

PATH = tf.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
DEFINITION = LIBRARY.to_str()
CACHE = tf.WordCache(DEFINITION, "<u2")


def whole(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet=[chr(c) for c in range(0x250)], max_size=30), st.text(alphabet="hKAa\u0331\u030a\u0307\u00c5İ1²'s. ", max_size=20), st.text(alphabet="aé \n\t\x0b\x1c\x85 　'sİΣé!<|endoftext|>", max_size=40)))
def test_word_cache_equals_whole_text_encoding(text):
    assert np.frombuffer(CACHE.encode(text), "<u2").tolist() == whole(text)[:-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "one", " ", "<|", "é²", "\n", "x"]), max_size=8).map("".join))
def test_added_tokens_are_what_the_library_makes_of_them(text):
    assert np.frombuffer(CACHE.encode(text), "<u2").tolist() == whole(text)[:-1]


def test_other_rules_go_to_the_whole_tokenizer():
    rules = json.loads(DEFINITION)
    rules["normalizer"] = None
    other = json.dumps(rules)
    cache = tf.WordCache(other, "<u2")
    assert not cache.by_words
    for text in ("Hello World", "it's  two\nlines", "É"):
        assert np.frombuffer(cache.encode(text), "<u2").tolist() == Tokenizer.from_str(other).encode(text, add_special_tokens=False).ids


@given(st.binary(max_size=50), st.integers(0, 10**6), st.integers(1, 255))
def test_broken_records_are_noticed(payload, where, flip):
    data = bytearray(tf.frame(payload))
    assert bytes(tf.unframe(memoryview(bytes(data)), 0)[0]) == payload
    data[where % len(data)] ^= flip
    with pytest.raises(tf.BrokenRecord):
        tf.unframe(memoryview(bytes(data)), 0)


def test_round_trip_and_edges(spark):
    rows = [(5, "Hello World", 1), (None, "x", 2), (-3, None, 3), (9, "", 4), (5, "Hello World", 1), (7, "long text " * 20_000, 5), (5, "A", 6), (6, "one <|endoftext|> two", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long")
    shards = tf.write_tokens(docs, PATH, shared_path(spark, "t"), shard_rows=3)
    back = tf.read_tokens(shards).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.key for r in sorted(back, key=lambda r: r.start)] == [r[0] for r in order]
    at = 0
    for r, (_, text, _) in zip(sorted(back, key=lambda r: r.start), order):
        want = whole(text)
        assert list(r.ids) == want and r.start == at and r.n_tokens == len(want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    one = shards.first()
    index, width = tf.read_index(one.path)
    assert len(tf.read_record(one.path, int(index["offset"][-1]), width)) == index["n"][-1]
    empty = tf.write_tokens(docs.limit(0), PATH, shared_path(spark, "t"))
    assert empty.count() == 0 and tf.read_tokens(empty).count() == 0


def test_query_equals_the_library(spark, data):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/sf0.001/documents.parquet").collect())
    got = {r.doc_id: tuple(r) for r in tf.op5_token_files(spark, f"{data}/sf0.001").collect()}
    at = 0
    for doc, text in docs:
        ids = whole(text)
        assert got.pop(doc) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got
