import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from threadmill.llm import op3_classifier as op

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    half = labels.where(F.xxhash64("doc_id") % 2 == 0)
    got = op.classify(docs, half).join(labels.join(half, "doc_id", "left_anti"), "doc_id").select("quality", "kept").collect()
    right = sum(bool(r.quality) == r.kept for r in got) / len(got)
    good = [r.kept for r in got if r.quality == 1]
    print("held-out accuracy", right, "good kept", sum(good) / len(good), len(got))
    assert right > 0.95 and sum(good) / len(good) > 0.97


def test_shrinkage(spark):
    rows = [(i, "good words in a plain sentence, again and again. " * 3, "big", "a") for i in range(200)]
    rows += [(1000 + i, "X!! Y!! Z!! " * 20, "big", "b") for i in range(100)] + [(5000, "good words in a plain sentence, again. " * 3, "tiny", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in rows[:300]], "doc_id long, quality int")
    got = {r.doc_id: r for r in op.classify(docs, labels).collect()}
    assert got[0].kept and not got[1000].kept and got[5000].kept
    share = 201 / 301
    assert abs(got[5000].path_rate - share) < abs(1 - share)  # one document moves a sparse site only so far
    assert got[0].path_rate > got[0].host_rate > got[1000].path_rate


def test_fit():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(2000), rng.normal(size=2000)])
    y = (rng.random(2000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 1])))).astype(float)
    w = op.fit(x, y)
    assert abs(w[0] - 0.5) < 0.2 and abs(w[1] - 2) < 0.3


def test_edges(spark):
    rows = [(1, None, None, None), (1, None, None, None), (2, "", "s", "x"), (None, "w " * 50_000, "s", None)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, lang string, kept int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in op.classify(docs, none).collect()] == [True] * 4
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (7, None)], "doc_id long, quality int")
    assert op.classify(docs, labels).count() == 4
    assert op.classify(docs.limit(0), labels).count() == 0


def pseudo(groups):
    """(rows, rate, prior) of groups -> pseudo-counts by the method of moments."""
    n = sum(g[0] for g in groups)
    v = sum(g[0] * g[2] * (1 - g[2]) for g in groups)
    if not n or len(groups) < 2 or not v:
        return op.MOST_PSEUDO
    between = (sum(g[0] * (g[1] - g[2]) ** 2 for g in groups) - (len(groups) - 1) * v / n) / max(1e-9, n - sum(g[0] ** 2 for g in groups) / n)
    return min(op.MOST_PSEUDO, max(op.LEAST_PSEUDO, v / n / between - 1)) if between > 0 else op.MOST_PSEUDO


def brute(rows, weights, prior):
    """doc_id -> (posterior, kept) of (doc_id, text, source, lang), by loops over rows."""
    evidence = [min(30, max(-30, round(sum(a * b for a, b in zip(op.features(t), weights, strict=True)) - prior, 6))) for _, t, _, _ in rows]
    by_path, by_host = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (_, _, s, g), e in zip(rows, evidence, strict=True):
        x = math.floor(1_000_000 / (1 + math.exp(-(e + prior))) + 0.5)
        for sums in (by_path[s, g], by_host[s]):
            sums[0] += x
            sums[1] += 1
    overall = min(0.999, max(0.001, sum(x for x, _ in by_host.values()) / 1e6 / len(rows)))
    kh = pseudo([(n, x / 1e6 / n, overall) for x, n in by_host.values()])
    host = {k: (x / 1e6 + kh * overall) / (n + kh) for k, (x, n) in by_host.items()}
    kp = pseudo([(n, x / 1e6 / n, host[k[0]]) for k, (x, n) in by_path.items()])
    path = {k: (x / 1e6 + kp * host[k[0]]) / (n + kp) for k, (x, n) in by_path.items()}
    out = {}
    for (d, _, s, g), e in zip(rows, evidence, strict=True):
        p = min(0.999, max(0.001, path[s, g]))
        out[d] = 1 / (1 + math.exp(-(e + math.log(p / (1 - p)))))
    return out


def test_query_against_loops(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights, prior = op.train(docs, labels)
    want = brute([(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()], weights.tolist(), prior)
    got = op.query(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert abs(r.posterior - want[r.doc_id]) < 2e-6 and (r.kept == (want[r.doc_id] >= op.KEEP) or abs(want[r.doc_id] - op.KEEP) < 2e-6)


def test_columns_of_clashing_names_stay(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "'h' as _host", "1 as _path", "doc_id as kept", "7 as evidence", "null as nothing")
    kept = op.stage(spark, docs, sf)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert rows and all((r._host, r._path, r.kept, r.evidence) == ("h", 1, r.doc_id, 7) for r in rows)
    plain = {r.doc_id for r in op.query(spark, sf).where("kept").collect()}
    assert {r.doc_id for r in rows} == plain


def test_words_of_any_length():
    assert len(op.features("w" * 1_000_000)) == len(op.features(None)) and all(map(math.isfinite, op.features("w" * 1_000_000)))
