import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tidewell.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, digest string")


def test_round_trip(spark, tmp_path):
    a, b = "<p>" + "x" * 200, "é" * 60
    rows = [(3, "u3", a), (1, "u1", a), (2, None, a), (4, "u4", "small"), (5, "u5", "small"), (6, "u6", None), (7, "u7", ""), (9, "u9", b), (8, "u8\r\nX: y", b), (10, "u", "y" * 300_000), (None, "n", a), (1, "again", a)]
    path = f"file://{tmp_path}/w"
    warc.archive(pages(spark, [(*r, "x", "x") for r in rows]), path)
    got = sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(spark, path).collect()), key=repr)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = min(x for x, _, y in rows if (y or "") == (h or "") and x is not None)
        again = len(raw) >= 100 and i != first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)
    assert len([p for p in (tmp_path / "w").iterdir() if p.name.startswith("_files-")]) == 1
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    assert data.count(b"WARC/1.1\r\n") == len(rows)


def test_filters_reach_the_reader(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.archive(pages(spark, [(i, f"http://h{i % 3}/{i}", "x" * 150, "", "") for i in range(9)]), path)
    df = warc.read_warc(spark, path, payload=False).filter("warc_type = 'revisit' and target_uri like 'http://h1%' and content_length < 10")
    assert "Filter" not in df._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "").replace("isnotnull", "") or df.count() == 3
    assert sorted(r.target_uri for r in df.collect()) == ["http://h1/1", "http://h1/4", "http://h1/7"]
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, IsNull

    assert [*reader.pushFilters([EqualTo(("warc_type",), "response"), IsNull(("record_id",))])] == [IsNull(("record_id",))]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["warc_type"] for r in rows] == ["response"] and rows[0]["payload"] == b"x" * 150


def test_foreign_files(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: a;\r\n b\r\nContent-Length: 27\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\nhi" + b"\r\n\r\n"
    two = b"WARC/1.0\r\nwarc-type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(one + two + one)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + gzip.compress(one))
    for payload in (True, False):
        got = warc.read_warc(spark, f"file://{tmp_path}", payload).orderBy("file", "offset").collect()
        assert [r.warc_type for r in got] == ["response", "metadata", "response"] * 2 and got[0].content_type == "a; b"
        assert [r.payload for r in got] == ([b"hi", b"abc", b"hi"] * 2 if payload else [None] * 6)
    assert warc.read_warc(spark, f"file://{tmp_path}").filter(F.col("warc_type") == "metadata").count() == 2


def test_several_records_in_a_member(spark, tmp_path):
    record = lambda n, kind: b"WARC/1.0\r\nWARC-Type: %s\r\nContent-Length: %d\r\n\r\n" % (kind, n) + b"x" * n + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record(5, b"warcinfo") + record(200_000, b"resource") + record(0, b"metadata")) + gzip.compress(record(7, b"resource")))
    for payload in (True, False):
        got = warc.read_warc(spark, f"file://{tmp_path}", payload).collect()
        assert [(r.warc_type, r.content_length) for r in got] == [("warcinfo", 5), ("resource", 200_000), ("metadata", 0), ("resource", 7)]
        assert not payload or [len(r.payload) for r in got] == [5, 200_000, 0, 7]
    assert [r.content_length for r in warc.read_warc(spark, f"file://{tmp_path}").filter("warc_type = 'resource'").collect()] == [200_000, 7]


@pytest.mark.parametrize("name", ["a.warc", "a.warc.gz"])
def test_damaged_archives(spark, tmp_path, name):
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 280\r\n\r\n" + bytes(range(256)) + b"y" * 24 + b"\r\n\r\n"
    pack = gzip.compress if name.endswith("gz") else bytes
    for cut in (len(pack(one)) + 20, len(pack(one)) + len(pack(one)) // 2, 2 * len(pack(one)) - (6 if name.endswith("gz") else 100)):
        (tmp_path / name).write_bytes((pack(one) + pack(one))[:cut])
        for payload in (True, False):
            with pytest.raises(Exception, match="cut off|damaged|no gzip member"):
                warc.read_warc(spark, f"file://{tmp_path}", payload).collect()
        got = warc.read_warc(spark, f"file://{tmp_path}", mode="permissive").collect()
        assert [len(r.payload) for r in got][:1] == [280] and len(got) <= 2
    (tmp_path / name).write_bytes(b"")
    assert warc.read_warc(spark, f"file://{tmp_path}").count() == 0


def test_only_accepted_files_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.archive(pages(spark, [(1, "u", "a" * 200, "", "")]), path)
    mine = next((tmp_path / "w").glob("*.warc.gz"))
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(mine.read_bytes())
    assert [r.id for r in warc.archived(spark, path).collect()] == [1]
    warc.archive(pages(spark, [(2, "u", "b" * 200, "", "")]), path)
    assert sorted(r.id for r in warc.archived(spark, path).collect()) == [1, 2]


def test_no_pages(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.archive(pages(spark, []), path)
    assert warc.archived(spark, path).count() == 0
