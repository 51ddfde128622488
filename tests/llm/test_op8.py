import gzip
import hashlib
import io

import pytest
from pyspark.sql.datasource import EqualTo

from threadmill.llm import op8_warc as op


def brute(rows):
    first, out = {}, []
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(first.get(p, i), i)
    for i, _, h in rows:
        p = (h or "").encode()
        again = len(p) >= 100 and p in first and first[p] != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=str)


def test_rows(spark):
    long = "WARC/1.1\r\n\r\n" + "é" * 100
    rows = [(5, "u", long), (3, "u\r\nX: y", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "x" * 300_000), (None, "u", long), (3, "u", long)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    assert sorted((tuple(r) for r in op.of(spark, df).collect()), key=str) == brute(rows)
    assert op.of(spark, df.limit(0)).count() == 0


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in op.of(spark, df).collect()), key=str) == brute(rows)


def test_pushdown(spark, tmp_path):
    html = "z" * 200
    df = spark.createDataFrame([(i, f"http://h/{i}", html if i < 5 else f"{i}" * 200) for i in range(20)], "page_id long, url string, html string")
    op.archive(df, str(tmp_path / "a"))
    back = spark.read.format("warc").load(str(tmp_path / "a"))
    assert back.where("record_type = 'revisit'").count() == 4
    assert [r.target_uri for r in back.where("record_id = 'urn:page:7' and length(payload) > 1").collect()] == ["http://h/7"]
    assert back.where("target_uri in ('http://h/1', 'http://h/9') and record_type = 'response'").count() == 1
    none = spark.read.format("warc").option("payload", "false").load(str(tmp_path / "a"))
    assert none.where("payload is not null").count() == 0 and none.count() == 20
    reader = op.WarcReader({"path": str(tmp_path / "a")})
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), other := EqualTo(("offset",), 3)])) == [other]
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == ["revisit"] * 4


def test_headers_first():
    made = [{"record_type": t, "record_id": f"r{i}", "payload_digest": "d", "full_length": 9, "payload": b"p" * 200_000} for i, t in enumerate(("response", "revisit", "response"))]
    raw = b"".join(map(op.member, made))
    plain = gzip.decompress(raw)
    bare = b"".join(gzip.compress(op.header_bytes(r) + r["payload"] + b"\r\n\r\n") for r in made)
    for data in (raw, plain, bare):
        got = list(op.records(io.BytesIO(data), len(data), op.Wanted({"record_type": {"response"}})))
        assert [op.field(h, "record_id") for _, h, _ in got] == ["r0", "r2"]
        assert all(p == b"p" * 200_000 for _, _, p in got)
        assert [p for *_, p in op.records(io.BytesIO(data), len(data), payload=False)] == [None] * 3
    with pytest.raises(ValueError):
        list(op.records(io.BytesIO(raw[:100]), 100))


def test_two_writers_to_one_path(tmp_path):
    record = {"record_type": "response", "record_id": "urn:page:1", "target_uri": "u", "refers_to": None, "payload_digest": "d", "full_length": 1, "payload": b"x"}
    a, b = (op.WarcWriter({"path": str(tmp_path)}, False) for _ in range(2))
    wrote = [w.write(iter([record])) for w in (a, b)]
    a.commit([wrote[0]])
    b.commit([wrote[1]])
    op.WarcWriter({"path": str(tmp_path)}, False).abort([])
    assert len(op.WarcReader({"path": str(tmp_path)}).partitions()) == 2 and not list(tmp_path.glob("_parts*"))
