import random
import time
from collections import Counter

import numpy as np
import pytest

from threadmill.llm import op6_minhash as op


def shingle_bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows):
    """doc_id by class, by comparing all pairs."""
    texts = sorted({t or "" for _, t in rows})
    bags, root = [shingle_bag(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if a and b and 5 * (s := sum((a & b).values())) >= 4 * (sum(a.values()) + sum(b.values()) - s):
                root[find(i)] = find(j)
    of = {t: find(i) for i, t in enumerate(texts)}
    groups = {}
    for d, t in rows:
        groups.setdefault(of[t or ""], []).append(d)
    return sorted(sorted(g) for g in groups.values())


def grouped(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.class_id, []).append(r.doc_id)
    for k, g in groups.items():
        assert k == min(g)
    return sorted(sorted(g) for g in groups.values())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def test_unbiased():
    rng = np.random.default_rng(1)
    for most in (1, 3, 50):
        got, want = [], []
        for _ in range(80):
            e = np.unique(rng.integers(0, 2**63, 150).astype(np.uint64))
            c, d = rng.integers(0, most + 1, len(e)), rng.integers(0, most + 1, len(e))
            d = np.where(rng.random(len(e)) < 0.7, c, d)
            s = op.signatures([(e[c > 0], c[c > 0]), (e[d > 0], d[d > 0])])
            got.append((s[0] == s[1]).mean())
            want.append(np.minimum(c, d).sum() / np.maximum(c, d).sum())
        assert abs(np.mean(got) - np.mean(want)) < 0.02


def test_alone_or_in_a_batch():
    bags = [op.bag(t) for t in ("a b c d e f g", "x " * 5000, "one", " ".join(f"w{i}" for i in range(5000)))]
    together = op.signatures(bags)
    for i, b in enumerate(bags):
        assert (op.signatures([b])[0] == together[i]).all()


def test_groups_of_copies_and_chains(spark):
    rng, rows = random.Random(4), []
    common = " ".join(f"common{i}" for i in range(55))
    for k in range(300):  # many texts that share a passage
        rows.append((len(rows), f"{common} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))))
    base = [f"b{i}" for i in range(300)]
    rows += [(len(rows) + i, edited(rng, base, 4)) for i in range(250)]
    rows += [(len(rows) + i, "copy of this very text here, word for word") for i in range(100)]
    for k in range(20):
        t = [f"t{k}_{i}" for i in range(rng.randrange(5, 200))]
        rows += [(len(rows) + i, edited(rng, t, rng.randrange(3))) for i in range(4)]
    rows += [(len(rows) + i, t) for i, t in enumerate((None, "", "a", "a", "a b", "a b", "q " * 900, "q " * 850, "q " * 500, "z" * 100_000))]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    assert grouped(op.classes(df)) == brute(rows)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert grouped(op.classes(df)) == brute([(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize("rows", [[], [(1, "only")], [(None, "x y"), (3, "x y"), (3, "x y")], [(None, None)]])
def test_small(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = op.classes(df).collect()
    assert len(got) == len(rows)
    if len(rows) == 3:
        assert {r.class_id for r in got} == {3}


def test_buckets_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "SCAN", 50)
    monkeypatch.setattr(op, "BLOCK", 20)
    rng, rows = random.Random(8), []
    common = " ".join(f"common{i}" for i in range(80))
    for _ in range(150):  # texts that share much, but too little
        rows.append((len(rows), f"{common} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))))
    for k in range(12):  # and groups of near copies that share it too
        own = [f"g{k}_{i}" for i in range(200)]
        rows += [(len(rows) + i, f"{common} " + edited(rng, own, 3)) for i in range(8)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert grouped(op.classes(df)) == brute(rows)


def test_signatures_that_go_on():
    import pandas as pd

    rng = np.random.default_rng(2)
    sig = rng.integers(0, 256, (60, op.M)).astype(np.uint8)
    sig[30:] = np.where(rng.random((30, op.M)) < 0.7, sig[:30], sig[30:])
    root = [bytes([i % 7]) for i in range(60)]
    for mine in ([0] * 60, [i // 30 for i in range(60)]):
        want = {z for x in range(60) for y in range(x) if (len(set(mine)) == 1 or mine[x] != mine[y]) and root[x] != root[y] and (sig[x] == sig[y]).sum() >= op.LEAST_EQUAL for z in (x, y)}
        assert set(op._near(pd.DataFrame({"sig": [s.tobytes() for s in sig], "root": root, "mine": mine})).tolist()) == want and want


def test_shuffles_go_as_steps_end(spark, monkeypatch):
    """No shuffle stays on the disk for the steps that follow: in the pipeline on check_h they added up to more than its disk."""
    jvm, held, saved = spark.sparkContext._jvm, [], op.saved

    def shuffles():
        files = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n.split("_")[1] for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    def noted(df):
        time.sleep(0.5)  # Spark removes them in a thread of its own
        held.append(shuffles() - before)
        return saved(df)

    rng, rows = random.Random(5), []
    for k in range(40):
        own = [f"g{k}_{i}" for i in range(100)]
        rows += [(len(rows) + i, edited(rng, own, i)) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = shuffles()
    monkeypatch.setattr(op, "saved", noted)
    assert grouped(op.classes(df)) == brute(rows)
    assert len(held) > 12 and set().union(*held)
    for k in range(len(held) - 4):
        assert not held[k] & held[k + 4]
