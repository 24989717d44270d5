import random
import zlib

import pyarrow as pa
from pyarrow import fs

from tracelode.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, `first` long, `a.b` int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(3)


def back(spark, rows, tmp_path, **options):
    files = warc.write_warc(pages(spark, rows), f"file://{tmp_path}/out-{len(list(tmp_path.iterdir()))}", **options)
    assert files.agg({"n_records": "sum"}).first()[0] == (len(rows) or None)
    assert warc.read_gaps(files).count() == 0
    return files


ROWS = [(1, "http://a/", "one"), (2, "http://b/ x\r\ny", "two"), (3, None, "one"), (4, "u", None), (5, "u", ""), (None, "u", "one"), (None, "n", "alone"), (6, "u", "WARC/1.1\r\n\r\n\x1f é😀"), (7, "big", "long " * 400_000), (7, "big", "long " * 400_000), (-8, "neg", "two")]


def test_payloads_and_revisits_come_back(spark, tmp_path):
    for compress in (True, False):
        files = back(spark, ROWS, tmp_path, compress=compress, shard_bytes=1000)
        assert files.count() > 3
        records = warc.with_payloads(warc.read_warc(files)).collect()
        said = sorted((r.record_id.split(":")[2], bytes(r.payload).decode(), r.n_bytes, r.type, r.refers_to and r.refers_to.split(":")[2]) for r in records)
        first = {"one": 3, "two": 2, "": 5, "long " * 400_000: 7}
        want = sorted(("" if k is None else str(k), h or "", len((h or "").encode()), "revisit" if (h or "") in first and k != first[h or ""] else "response", str(first[h or ""]) if (h or "") in first and k != first[h or ""] else None) for k, _, h in ROWS)
        assert said == want
        assert all(r.payload_digest == warc.digest(bytes(r.payload)) for r in records)
        assert {r.target for r in records} == {"http://a/", "http://b/%20x%0D%0Ay", None, "u", "n", "big", "neg"}


def test_short_payloads_may_stay_responses(spark, tmp_path):
    records = warc.read_warc(back(spark, [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaa"), (4, "u", "aaa")], tmp_path, least_revisit=3)).collect()
    assert sorted((r.record_id[10:11], r.type) for r in records) == [("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response")]


def test_empty_table(spark, tmp_path):
    assert warc.read_warc(back(spark, [], tmp_path)).count() == 0


def scanned(data):
    return list(warc.salvage(pa.BufferReader(data)))


def records(n, compress, seed=0):
    rng = random.Random(seed)
    made = [warc.page_record(i, f"u{i}", bytes(rng.choices(range(97, 110), k=rng.choice([0, 20, 3000]))), None if i % 3 else 9, "d") for i in range(n)]
    return [warc._member(r) if compress else r for r in made]


def plain(parts, data, broken):
    """What is found, by the places of the whole records that are not broken."""
    out, at, bad = [], 0, None
    for i, p in enumerate(parts):
        if i in broken:
            bad = at if bad is None else bad
        else:
            if bad is not None:
                out.append(("gap", bad, at - bad))
                bad = None
            out.append(("record", at, len(p)))
        at += len(p)
    return out + ([("gap", bad, len(data) - bad)] if bad is not None else [])


def test_damage_costs_only_the_records_it_hits():
    rng = random.Random(5)
    for compress in (True, False):
        for trial in range(40):
            parts = records(12, compress, trial)
            broken = set(rng.sample(range(12), 3))
            for i in broken:
                p = bytearray(parts[i])
                kind = rng.choice(["zero", "cut", "start", "garbage"])
                if kind == "cut":
                    p = p[: rng.randrange(1, len(p))]
                elif kind == "start":
                    p[:12] = b"x" * 12
                elif kind == "garbage":
                    p = bytearray(rng.randbytes(rng.randrange(1, 5000)))
                else:
                    at = rng.randrange(12, len(p) - 12)
                    p[at : at + 8] = b"\0" * 8
                parts[i] = bytes(p)
            data = b"".join(parts)
            got = [x[:3] for x in scanned(data)]
            assert got == plain(parts, data, broken), (compress, trial)


def test_reasons_and_fields():
    a, b = records(2, False)
    bad = b.replace(b"WARC-Block-Digest: sha1:", b"WARC-Block-Digest: sha1:A")
    assert [x[3] for x in scanned(bad + a) if x[0] == "gap"] == ["warc-block-digest"]
    assert [x[3] for x in scanned(a + b[:-4]) if x[0] == "gap"] == ["truncated record"]
    two = zlib.compressobj(6, zlib.DEFLATED, 31)
    assert [x[3] for x in scanned(two.compress(a + b) + two.flush()) if x[0] == "gap"] == ["member with more than a record"]
    assert scanned(b"") == [] and [x[:3] for x in scanned(b"junk")] == [("gap", 0, 4)]
    folded = warc.make_record([("WARC-Type", "metadata"), ("X", "one\r\n two")], b"text")
    (found,) = scanned(folded)
    assert found[3]["x"] == "one two" and found[5] == b"text"


def test_candidates_across_windows(monkeypatch):
    monkeypatch.setattr(warc, "WINDOW", 16)
    for compress in (True, False):
        parts = records(4, compress)
        data = b"z" * 1001 + b"".join(parts)
        assert [x[:3] for x in scanned(data)] == [("gap", 0, 1001)] + [(k, at + 1001, n) for k, at, n in plain(parts, data, set())]


def test_gaps_are_reported_from_files(spark, tmp_path):
    files = back(spark, [(i, "u", f"text {i} " * 50) for i in range(40)], tmp_path)
    path = files.orderBy("path").first().path
    system, name = fs.FileSystem.from_uri(path)
    with open(name, "r+b") as f:
        data = f.read()
        second = data.index(b"\x1f\x8b\x08", 20)
        f.seek(second + 30)
        f.write(b"\xff" * 4)
    (gap,) = warc.read_gaps(files).collect()
    assert (gap.path, gap.offset) == (path, second) and gap.length == data.index(b"\x1f\x8b\x08", second + 1) - second
    assert warc.read_warc(files).count() == 39


def test_query_covers_pages(spark, data):
    got = {r.page_id: r for r in warc.op12_warc(spark, f"{data}/sf0.001").collect()}
    rows = spark.read.parquet(f"{data}/sf0.001/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].payload_digest == warc.digest((r.html or "").encode()) and got[r.page_id].payload_bytes == len((r.html or "").encode())
