import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmill.llm import op9_language as op
from threadmill.llm.common import small


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trained = op.train(docs.where("doc_id % 2 = 0"), 300)
    rows = docs.where("doc_id % 2 = 1").select("lang", F.col("text"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))
    got = op.identify(rows, trained).collect()
    assert sum(r.lang == r.language for r in got) / len(got) > 0.98
    short = op.identify(rows.withColumn("text", F.expr("array_join(slice(split(text, ' '), 1, 12), ' ')")), trained).collect()
    assert sum(r.lang == r.language for r in short) / len(short) > 0.95


def test_pages(spark):
    docs, pages = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "pages"))
    got = op.identify(op.evidence_rows(docs, pages), op.train(docs)).where("kind = 'page'").collect()
    want = {r.page_id: r.l for r in pages.select("page_id", F.regexp_extract("html", 'lang="(..)"', 1).alias("l")).collect()}
    assert sum(want[r.id] == r.language for r in got) / len(got) > 0.98


def test_fusion(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog are here", "en"), ("der hund und die katze sind hier", "de")] * 20)], "doc_id long, text string, lang string")
    trained = op.train(docs)
    rows = [("the dog", "en", "com", "a.com")] * 60 + [("der hund und die", "de", "de", "b.de")] * 60 + [("", "de", None, None), (None, None, None, "b.de"), (None, None, "com", "new.com"), ("und die", "en", "com", "a.com"), (None, None, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "text string, declared string, suffix string, host string, language string")
    got = [(r.host, r.declared, r.language, r.text_language) for r in op.identify(df, trained).collect()]
    assert got.count(("a.com", "en", "en", "en")) == 60 and got.count(("b.de", "de", "de", "de")) == 60
    assert (None, "de", "de", None) in got and ("new.com", None, "en", None) in got
    assert ("a.com", "en", "de", "de") in got or ("a.com", "en", "en", "de") in got
    assert op.identify(df.limit(0), trained).count() == 0
    assert op.identify(df, op.train(docs.limit(0))).where("language is null").count() == len(rows)


def test_long_words_are_scored_whole():
    assert op.trigrams("ab") == [" ab", "ab "] and all(op.trigrams("x" * n) == [f" {'x' * n} "[i:i + 3] for i in range(n)] for n in (1, 40, 41, 80, 200))
    rows = [{"lang": "aa", "w": "abc" * 30, "c": 1}, {"lang": "bb", "w": "xyz" * 30, "c": 1}]
    of = op.Likelihoods(*op.model(rows))
    said = of("q" * 60 + "xyz" * 20)  # nothing known in its first 40 letters
    assert said[1] > said[0]


def test_rare_languages_keep_their_words(spark, monkeypatch):
    monkeypatch.setattr(op, "VOCABULARY", 5)
    rows = [(i, "the cat and dog are here", "en") for i in range(20)] + [(20 + i, f"wort{chr(97 + i // 26)}{chr(97 + i % 26)}", f"l{i}") for i in range(70)]
    langs, words, _ = op.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(langs) == 71 and {"wortaa", "wortcr", "cat"} <= set(words)


def brute(rows, trained):
    """(language, confidence) of (text, declared, suffix, host) rows, by loops."""
    langs, words, grams = trained
    of, n = op.Likelihoods(langs, words, grams), len(langs)
    lls = [np.round(of(t), 6) for t, *_ in rows]
    keys = [((d or "").replace("_", "-").split("-")[0].lower(), (s or "").lower(), (h or "").lower()) for _, d, s, h in rows]
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    sums = [defaultdict(lambda: np.zeros(n)) for _ in range(4)]
    for ll, (d, s, h) in zip(lls, keys, strict=True):
        p = np.floor(soft(ll) * 1e6 + 0.5) if ll.any() else np.zeros(n)
        for group, k in zip(sums, ((), s, (s, h), d), strict=True):
            group[k] += p
    overall = (sums[0][()] + 1) / (sums[0][()].sum() + n)
    rate = lambda c, prior: (c / 1e6 + op.PSEUDO * prior) / (c.sum() / 1e6 + op.PSEUDO)
    out = []
    for ll, (d, s, h) in zip(lls, keys, strict=True):
        prior = rate(sums[2][s, h], rate(sums[1][s], overall))
        spoken = np.log(rate(sums[3][d], overall) / overall) if d else 0.0
        p = soft(ll + np.log(prior) + spoken)
        out.append((langs[int(p.argmax())], float(p.max()), langs[int(ll.argmax())] if ll.any() else None))
    return out


@pytest.mark.parametrize("most", [1 << 25, -1])
def test_query_against_loops(spark, monkeypatch, most):
    monkeypatch.setattr(op, "small", lambda df: small(df, most))
    sf = "/root/testdata/sf0.001"
    docs, pages = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pages"))
    trained, df = op.train(docs), op.evidence_rows(docs, pages)
    rows = df.collect()
    want = {(r.kind, r.id): w for r, w in zip(rows, brute([(r.text, r.declared, r.suffix, r.host) for r in rows], trained), strict=True)}
    got = op.query(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        language, confidence, alone = want[r.kind, r.doc_id if r.kind == "document" else r.page_id]
        assert (r.language, r.text_language) == (language, alone) and math.isclose(r.confidence, confidence, abs_tol=2e-6)


def test_clashing_names_and_very_long_words(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("z" * 100_000, "zz")] * 9)], "doc_id long, text string, lang string")
    df = docs.selectExpr("text", "null as declared", "null as suffix", "null as host", "1 as _ll", "2 as _host", "3 as _key", "4 as _p", "5 as _declared", "6 as _prior", "lang")
    got = op.identify(df.select(*[F.col(c).cast("string").alias(c) if c in ("declared", "suffix", "host") else c for c in df.columns]), op.train(docs)).collect()
    assert all(r.language == r.lang and (r._ll, r._host, r._key, r._p, r._declared, r._prior) == (1, 2, 3, 4, 5, 6) for r in got) and len(got) == 27
