import zlib
from collections import Counter, defaultdict
from hashlib import md5

from threadmill.llm import op7_sharding as op


def check(rows, got):
    assert len(got) == len(rows)
    n = Counter(r.shard for r in got)
    sizes = [n[s] for s in range(op.SHARDS)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(op.SHARDS):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))


def brute(rows):
    by = defaultdict(list)
    for d, _, s in rows:
        by[s].append((int(md5(f"{op.SEED}:{d}".encode()).hexdigest()[:15], 16), d))
    order = []
    for s, x in by.items():
        for k, (_, d) in enumerate(sorted(x), 1):
            order.append(((2 * k - 1) / (2 * len(x)), '{"source":"%s"}' % s, k, d))
    return {d: i * op.SHARDS // len(rows) for i, (_, _, _, d) in enumerate(sorted(order))}


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = op.of(docs).collect()
    check(rows, got)
    want = brute(rows)
    text = {d: t for d, t, _ in rows}
    for r in got:
        assert r.shard == want[r.doc_id]
        assert r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())


def test_mixture(spark):
    rows = [(i, "x", "hot" if i % 3 else f"s{i % 7}") for i in range(4000)]
    got = op.of(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    check(rows, got)
    share = Counter(r.source for r in got)
    for s in range(op.SHARDS):
        here = Counter(r.source for r in got if r.shard == s)
        for k, n in share.items():
            # a cut by rows is off the cut by fractional rank by half a row a source at most
            assert abs(here[k] - n / op.SHARDS) <= 1 + len(share) * n / len(rows)


def test_edges(spark):
    rows = [(1, None, None), (1, None, None), (None, "", "a"), (2, "é", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as shard", "2 as slot")
    got = op.of(df).collect()
    check(rows, got)
    assert sorted(r.size for r in got) == [16, 16, 16, 18]
    assert op.of(df.limit(0)).count() == 0


def test_equal_ranks_null_ids_and_equal_rows_are_dealt(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).selectExpr("id as doc_id", "'t' as text", "concat('s', id) as source").unionAll(spark.range(10_000).selectExpr("cast(null as bigint)", "'same'", "'hot'"))
    df = rows.withColumns({"_row": F.lit(1), "_source": F.lit(2), "_digest": F.lit(3)})
    got = op.of(df).collect()
    check(list(range(30_000)), got)
    each = Counter(r.shard for r in got if r.source == "hot")
    # the one-row sources all have rank 1/2, so they stand between the halves of the hot one
    assert sum(each.values()) == 10_000 and each[0] == each[op.SHARDS - 1] == 750
    kept = op.interleave(df.select("doc_id", "source", "_row", "_source", "_digest"))
    assert kept.columns == ["doc_id", "source", "_row", "_source", "_digest", "shard", "slot"]
    assert kept.where("_row = 1 and _source = 2 and _digest = 3").count() == 30_000
