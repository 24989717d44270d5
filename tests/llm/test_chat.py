import hashlib
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tracelode.llm import chat


def plain(rows):
    """conv_id -> (formatted, turns, loss text) by string work, for rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: (x[0], x[1], esc(x[2]), esc(x[3])))
        turns = [(role, text) for _, _, role, text in mine]
        said, before = "", None
        for role, text in turns:
            said += chat.TURN if role == before else (chat.END if before is not None else "") + f"{chat.START}{esc(role).replace(chr(10), '&nl;')}\n"
            said += esc(text)
            before = role
        out[conv] = said + chat.END, turns, "".join(text for role, text in turns if role == "assistant")
    return out


def esc(text):
    return text.replace("&", "&amp;").replace("<|", "&lt;|")


def both(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    return {r.conv_id: (r.formatted, [(t.role, t.text) for t in r.turns], r.loss_text) for r in chat.read_chats(chat.format_chats(table)).collect()}


def test_formats_and_reads_back(spark):
    rows = [
        (1, 1, "user", "hi"), (1, 0, "system", "be kind"), (1, 2, "assistant", "yes <|turn|> &amp; <|im_end|>\n<|im_start|>user\nno"), (1, 3, "assistant", "\nmore\n"), (1, 4, "user", None),
        (2, 0, "assistant", ""), (3, None, None, "no role"), (3, 0, "assistant", "é😀"), (3, 0, "assistant", "é😀"), (None, 0, "user", "no conversation"), (4, 1, "user", "b"), (4, 1, "user", "a"), (5, 0, "odd\nrole", "x"), (6, 0, "assistant", "long " * 50_000),
    ]
    assert both(spark, [(*r, "clash") for r in rows]) == plain(rows)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5), st.sampled_from(["user", "assistant", None]), st.text(alphabet="a<|>&;lt\nturnim_ends", max_size=12)), min_size=1, max_size=25))
def test_any_texts_come_back(spark, rows):
    assert both(spark, [(*r, None) for r in rows]) == plain(rows)


def test_empty_table_and_probe(spark, data):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(empty).count() == 0
    r = {r.conv_id: r for r in chat.op10_chat_formatting(spark, f"{data}/sf0.001").collect()}[-1]
    want = f"user\n{chat.PROBE}\nassistant\n{chat.PROBE}\n"
    assert (r.n_turns, r.turns_sha256, r.loss_sha256, r.loss_chars) == (2, hashlib.sha256(want.encode()).hexdigest(), hashlib.sha256(chat.PROBE.encode()).hexdigest(), len(chat.PROBE))


def test_long_conversations_take_time_in_proportion(spark):
    took = []
    for n in (4_000, 4_000, 32_000):
        rows = spark.range(n).selectExpr("7L conv_id", "id turn", "if(id % 3 = 0, 'user', 'assistant') role", "concat('text ', id, repeat(' word', 20)) text")
        began = time.perf_counter()
        r = chat.read_chats(chat.format_chats(rows)).selectExpr("size(turns) n", "length(loss_text) m").first()
        took.append(time.perf_counter() - began)
        assert r.n == n and r.m > 100 * n * 0.6
    assert took[2] < 16 * took[1] + 1, took
