import hashlib
import re

import public_tokenizers
import pytest
from test_op4 import brute as contaminated
from test_op6 import brute as groups

import corpus_pipeline
from threadmill.llm import op3_classifier, op5_pii, op10_bpe

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """The documents before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_columns(steps):
    assert all(x.columns == steps[0].columns for x in steps[1:-1])


def test_each_stage_against_brute_force(spark, steps):
    rows = [{r.doc_id: r for r in x.collect()} for x in steps]
    kept = {r.doc_id for r in op3_classifier.query(spark, SF).where("kept").collect()}
    assert rows[1].keys() == kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d in kept for d in rows[0] if labels.get(d) == 1]
    assert sum(good) > 0.97 * len(good)
    assert rows[2].keys() == {min(g) for g in groups([(d, r.text) for d, r in rows[1].items()])}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows[3].keys() == rows[2].keys() - contaminated([(d, r.text) for d, r in rows[2].items()], bench)
    assert rows[4].keys() == rows[3].keys() == rows[5].keys()
    for d, r in rows[4].items():
        assert r.n_chars == len(r.text)
        assert (r.text == rows[3][d].text) == (not re.search(op5_pii.PATTERN, rows[3][d].text)) or not set(re.findall(op5_pii.PATTERN, r.text)) & set(re.findall(op5_pii.PATTERN, rows[3][d].text))
    enc = op10_bpe.load(public_tokenizers.path(op10_bpe.RANKS), public_tokenizers.PATTERN)
    for d, r in rows[5].items():
        assert r.round_trip and r.n_tokens == len(r.ids) and list(r.ids) == enc.encode_ordinary(rows[4][d].text), d


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    digest = lambda df: sorted((r.doc_id, r.n_tokens, hashlib.md5(str(list(r.ids)).encode()).hexdigest()) for r in df.collect())
    assert digest(got) == digest(steps[-1])


def test_odd_rows(spark):
    from threadmill.llm import op6_minhash

    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None), (3, ""), (None, "only here"), (5, "x y"), (5, "y x")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, root int")
    got = sorted(((r.doc_id, r.text) for r in op6_minhash.stage(spark, df, SF).collect()), key=str)
    assert got == sorted([(1, "a b c"), (2, None), (None, "only here"), (5, "x y"), (5, "y x")], key=str)
    for _, stage in corpus_pipeline.STAGES:
        empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
        assert stage(spark, empty, SF).count() == 0
