import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tracelode.functions import hashing, mathfn, text, timefn


@pytest.fixture(scope="module")
def one(spark):
    def run(make, *values):
        row = spark.createDataFrame([values], ", ".join(f"c{i} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for i, v in enumerate(values)))
        return row.select(make(*[F.col(c) for c in row.columns]).alias("x")).first().x

    return run


def test_hashes(one):
    assert one(hashing.stable_hash, "abc") == hashlib.sha256(b"abc").hexdigest()[:16]
    assert one(lambda c: hashing.hmac_sha256(b"key", c), "abc") == hmac.new(b"key", b"abc", "sha256").hexdigest()
    h = 0x811C9DC5
    for ch in "session-1":
        h = ((h ^ ord(ch)) * 0x01000193) % (1 << 32)
    assert one(hashing.fnv1a_32, "session-1") == h
    assert one(hashing.opaque if hasattr(hashing, "opaque") else text.opaque_identifier, "a/b").startswith("private-")
    assert one(text.opaque_identifier, "plain") == "plain"


def test_redaction_and_titles(one):
    assert one(lambda c: text.bounded_text(c, 240), " see /Users/me/x.txt\n a@b.io\tapi_key=abc https://x.y/z.git ") == "see [path] [email] [secret] [url]"
    assert one(lambda c: text.bounded_text(c, 4), "abcdef") == "abcd…"
    assert one(lambda c: text.bounded_text(c, 4), " \n") is None
    assert one(text.clean_title, "[$grill-me](x) 1. /plan @me TokenGraph now") == "TokenGraph now"
    assert one(text.clean_title, "- ") == "-"
    assert one(text.title, "## ok") == "## ok"


@pytest.mark.parametrize("raw, want", [("Read File!", "ReadFile"), ("a@b.io", "other"), ("", "other"), ("mcp__x.y-z", "mcp__x.y-z")])
def test_tool_names(one, raw, want):
    assert one(text.tool_name, raw) == want


@pytest.mark.parametrize("raw, want", [("/p/app/src/a.rs", "src/a.rs"), ("/etc/hosts", "[external]/hosts"), ("../x", None), ("./src//b", "src/b"), ("'src/c'", "src/c"), ("", None), ("/p/app/../x", None)])
def test_project_paths(one, raw, want):
    assert one(text.project_path, "/p/app", raw) == want


@pytest.mark.parametrize("command, want", [
    ("cd x && pytest -q", "test"), ("FOO=1 BAR=2 cargo test", "test"), ("env A=1 npm run build; ls", "build"), ("git status || true", "git-review"), ("xcodebuild -scheme A test", "test"),
    ("xcodebuild -scheme A", "build"), ("eslint .\nnpm install", "lint"), ("pip install x", "dependency"), ("(vite)", "preview"), ("npx tauri build", "deploy"), ("ls -la", "shell"), ("tsc --noEmit", "typecheck"),
])
def test_commands(one, command, want):
    assert one(text.command_category, command) == want


@pytest.mark.parametrize("name, want", [("WebSearch", "search"), ("view_image", "read"), ("apply_patch", "edit"), ("Task", "subagent"), ("browser_open", "web"), ("exec_command", "shell"), ("sleep", "other")])
def test_tools(one, name, want):
    assert one(text.tool_category, name) == want
    assert one(lambda n, c: text.event_category(n, c), name, "cargo check") == "typecheck"


def test_prompts(one):
    assert one(text.structured_prompt, "a\nb\nc") and one(text.structured_prompt, "- x") and not one(text.structured_prompt, "plain words")
    assert one(lambda c: text.mentions(c, text.ACCEPTANCE_WORDS), "Done WHEN green") and one(lambda c: text.mentions(c, text.SCOPE_WORDS), "只修改 x")
    assert not one(text.prompt_eligible, "<x>") and not one(text.prompt_eligible, "You are a bot") and one(text.prompt_eligible, "Build")


def test_paths_and_diffs(one):
    kinds = {k: one(lambda c, k=k: text.file_kinds(c)[k], "/app/docs/readme.md") for k in text.file_kinds(F.lit("x"))}
    assert kinds == {"document": True, "instruction": False, "style": False, "test": False, "infrastructure": False, "automation": False}
    ignore = ["*.log", "/build/", "!keep", "node_modules"]
    assert [one(lambda c: text.ignored_path(c, ignore), p) for p in ("a/x.log", "build/y", "src/node_modules/z", "src/keep", "rebuild")] == [True, True, True, False, False]
    d = one(text.diff_counts, "--- a\n+++ b\n+x\n+y\n-z\n c")
    assert (d.added, d.removed) == (2, 1)


def test_skills_share_quota(one):
    found = one(lambda c: text.skill_mentions(c, ["github:yeet", "grill-me", "pdf"]), "Run [$github:yeet](x) and $grill-me in $HOME, use the PDF skill")
    assert sorted(found) == ["github:yeet", "grill-me", "pdf"]
    assert [one(text.share_decision, s) for s in ("sk-abcdefghijklmnop", "me@x.io", "fine")] == ["block", "review", "safe"]
    assert one(lambda c: text.quota_used(c, "Current week"), "Current week 10% used\nCurrent week 30% left") == 70.0


def test_times(one):
    assert one(lambda c: F.unix_millis(timefn.epoch_instant(c)), 1_700_000_000.5) == 1_700_000_000_500
    assert one(lambda c: F.unix_millis(timefn.epoch_instant(c)), 1_700_000_000_000) == 1_700_000_000_000
    assert one(lambda c: timefn.local_date(timefn.instant(c), "Asia/Shanghai"), "2026-01-01T20:00:00Z") == "2026-01-02"
    assert one(timefn.date_or_prefix, "2026-01-05 whatever") == "2026-01-05" and one(timefn.date_or_prefix, "soon") is None
    assert one(lambda c: timefn.iso_week(timefn.instant(c)), "2027-01-01T00:00:00Z") == "2026-53"
    assert timefn.window_days("odd") == 30 and timefn.window_days("all") == 3651
    with pytest.raises(ValueError):
        timefn.menu_range("odd")


def test_math(one):
    assert one(lambda a, b: mathfn.ratio(a, b), 3.0, 0.0) == 0 and one(lambda a: mathfn.cap(a, 2.0), 1.0) == 50
    assert one(lambda a: mathfn.inverse(a), 130.0) == 0 and one(lambda a: mathfn.weighted((a, 0.5), (a, 0.25)), 200.0) == 75
    assert one(mathfn.tolerant_long, "12.7") == 12 and one(mathfn.tolerant_long, "-1") is None and one(mathfn.tolerant_double, "x") is None
    assert abs(one(lambda a: mathfn.half_life_weight(a), 45.0) - 0.5) < 1e-12


def test_addresses_are_found_as_by_the_plain_pattern_in_time_that_grows_with_the_text(spark):
    import random
    import re
    import time

    rng = random.Random(4)
    parts = ["a", "B1", ".", "-", "_", "%", "+", "@", "@b.cc", "x@y.org", " ", "é", ",", ".co", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(3000)] + ["a@b.cc.d@e.ff", ".%x@y.zz", "a@b.cc-d@e.ff@g.hh"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    got = rows.select(F.regexp_replace("t", text.EMAIL_ONCE, "$1[email]"), F.col("t").rlike(text.EMAIL_ONCE)).collect()
    plain = re.compile(text.EMAIL, re.ASCII)
    want = {t: (plain.sub("[email]", t), bool(plain.search(t))) for t in texts if t.isascii()}
    for t, r in zip([r.t for r in rows.collect()], got):
        if t in want:
            assert tuple(r) == want[t], t
    hostile = spark.createDataFrame([("x@ " + "a." * 32_000,), ("x@" + "a." * 32_000,), ("@" * 64_000,), ("a@" * 32_000,)], "t string")
    began = time.perf_counter()
    hostile.select(text.bounded_text(F.col("t"), 100), text.sensitive(F.col("t"))).collect()
    assert time.perf_counter() - began < 20
