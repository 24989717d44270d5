import functools

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelode.llm import pieces

PATH = pieces.default_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = pieces.Codec(pieces.load_model(PATH))
TEXT = st.one_of(
    st.text(max_size=40),
    st.text(alphabet="the in\n ▁aé梦ἡ😀", max_size=80),
    st.lists(st.sampled_from(["the", " ", "  ", "international", "aaaa", "梦", "\n", "😀", "theretofore", "    ", "<s>", "<0x41>"]), max_size=25).map("".join),
)


@settings(max_examples=800, deadline=None)
@given(TEXT)
def test_ids_equal_the_library(text):
    assert np.frombuffer(CODEC.encode_whole(text), np.int32).tolist() == LIBRARY.encode(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="thein梦aos", min_size=30, max_size=150), st.integers(16, 60))
def test_chunks_settle_to_the_same_path(text, chunk):
    text = pieces.SPACE + text
    bounds = [0, *[p for p, _ in pieces.cut_points(text, chunk, False)], len(text)]
    matrices, reach = [], 2 * CODEC.longest
    for p, q in zip(bounds, bounds[1:]):
        entries, exits = CODEC.transfer(text[max(0, p - reach) : p], text[p:q], p == 0, q == len(text))
        m = {}
        for o, n, bits in exits:
            for i, s in enumerate(entries):
                if bits >> i & 1:
                    m.setdefault(s, set()).add(pieces.START if q == len(text) else (o, n))
        matrices.append(m)

    def settle(part, entry, leave):
        if len(part) == 1:
            return [entry]
        half = len(part) // 2
        a, b = (functools.reduce(pieces.compose, x) for x in (part[:half], part[half:]))
        mid = pieces.between(a, b, entry, leave)
        return settle(part[:half], entry, mid) + settle(part[half:], mid, leave)

    states = settle(matrices, pieces.START, pieces.START)
    whole = []
    for k, (p, q) in enumerate(zip(bounds, bounds[1:])):
        whole += CODEC.path(text[max(0, p - reach) : p], text[p:q], states[k], None if q == len(text) else states[k + 1])
    assert whole == CODEC.path("", text, pieces.START, None)
    if len(matrices) > 2:
        a, b, c = matrices[:3]
        assert pieces.compose(pieces.compose(a, b), c) == pieces.compose(a, pieces.compose(b, c))


@pytest.mark.parametrize("text", ["梦里不知身是客一晌贪欢" * 500, "สวัสดีชาวโลกทุกคน" * 300, " " * 5000, "😀😃" * 2500, "\x01\x02" * 2500, "?!" * 2500, "\n" * 5000])
def test_long_texts_without_words(text):
    assert np.frombuffer(CODEC.encode_whole(text), np.int32).tolist() == LIBRARY.encode(text)


def test_giants_combine_matrices_in_a_tree(spark, monkeypatch):
    texts = {1: "words with spaces between them " * 400, 2: "梦thein" * 2500, 3: "x" * 9000 + " tail"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    seen, settle = [], pieces._settle

    def spy(level, ends):
        seen.append({(r.key, r.no): len(r.arcs) for r in level.collect()})
        return settle(level, ends)

    monkeypatch.setattr(pieces, "_settle", spy)
    assert {r.doc_id: list(r.ids) for r in pieces.encode(docs, PATH, chunk=1000).collect()} == {i: LIBRARY.encode(t) for i, t in texts.items()}
    by_text = {}
    for (key, no), n in seen[0].items():
        by_text.setdefault(key, []).append(n)
    assert len(by_text) == 3 and all(len(x) >= 9 for x in by_text.values())
    assert sorted(max(x) > 1 for x in by_text.values()) == [False, True, True]


@pytest.fixture(scope="module")
def rows():
    return [(1, None, "a"), (2, "", "b"), (3, "Hello  world\n\nfoo 😀", "c"), (3, "Hello  world\n\nfoo 😀", "c"), (4, "梦thein" * 900, None), (5, "some words and " * 700 + "x" * 3000 + " end", "d"), (6, " lead\ttab\x00 ", "e")]


def test_giant_texts_and_edge_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.decode(pieces.encode(docs, PATH, chunk=1000), PATH).collect()
    assert sorted(r.doc_id for r in out) == [1, 2, 3, 3, 4, 5, 6]
    for r in out:
        assert list(r.ids) == LIBRARY.encode(r.text or "") and r.decoded == (r.text or "")
    assert pieces.encode(docs.limit(0), PATH).count() == 0


def test_query_equals_the_library(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/sf0.001/documents.parquet").collect()}
    for r in pieces.op1_sentencepiece(spark, f"{data}/sf0.001").collect():
        assert list(r.ids) == LIBRARY.encode(texts[r.doc_id]) and r.round_trip and r.n_tokens == len(r.ids)
