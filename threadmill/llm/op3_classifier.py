"""Quality classifier: hierarchical empirical Bayes over document evidence, hosts and paths.

A logistic regression on features of the whole text is fitted to the SAMPLE labelled documents whose digest of the id is
least (a documented bound; that sample alone reaches the driver, as features). Its logit less the sample's prior logit is a
document's evidence. All documents' probabilities are then summed by path and by host; the rate of a host is shrunk
towards the global rate and that of a path towards its host's, by pseudo-counts that the method of moments finds from
the variation among hosts (or paths within hosts), so sparse sites count for little. The posterior joins a document's
evidence with its path's rate; documents below KEEP go.

Sums are of whole millionths, so results don't depend on the order of rows. Each text is scored once, and what follows
reads the saved evidence. Only grouped sums are shuffled, and the rows only where the rates are too many to broadcast.

Edge cases: null and empty texts have the features of an empty text; a null host or path is a group of its own; equal
rows get equal results; without labels of both kinds the evidence is nil and everything stays; an empty table gives
no rows; further columns, whatever their names, pass through ``classify``, and its outputs replace columns of their names
(the pipeline's stage returns the input's columns even then).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm.common import free_name, saved, small, small_batches, table, written

NAME = "op3_classifier"
#: Most labelled rows that the regression is fitted to, and the posterior from which a document stays.
SAMPLE, KEEP = 10_000, 0.5
OUT = ("evidence", "host_rate", "path_rate", "posterior", "kept")
#: Bounds of the pseudo-counts.
LEAST_PSEUDO, MOST_PSEUDO = 1.0, 1e6
RIDGE = 1.0
_SYMBOLS = "#*$%&|<>"


def features(text: str | None) -> list[float]:
    """Features of a whole text, each bounded."""
    text = text or ""
    words = text.split()
    n, c = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    kinds = len(set(words))
    same = sum(map(str.__eq__, words[1:], words)) if len(words) > 1 else 0
    upper = sum(w.isupper() for w in words if len(w) > 1)
    symbols = [text.count(x) for x in _SYMBOLS]
    stops = text.count(".") + text.count(",") + text.count(";") + text.count(":")
    marks = text.count("!") + text.count("?")
    return [
        1.0, math.log1p(len(words)) / 10, 1.0 if len(words) < 10 else 0.0, min(c / n, 30) / 10, kinds / n, math.log1p(n / max(1, kinds)),
        same / n, upper / n, min(sum(symbols) / n, 5), min(symbols[5] / n, 2), min(marks / n, 5), min(stops / n, 2),
        len(set(lines)) / max(1, len(lines)), min(len(lines) / n, 1), min(sum(map(text.count, "0123456789")) / c, 1), 1.0 if sum(symbols) > 0.1 * n else 0.0,
    ]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method with halved steps."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (x @ w)).sum() + (penalty * w * w).sum() / 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        t = 1.0
        while loss(w - t * step) > loss(w) and t > 1e-6:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-9:
            break
    return w


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts], dtype=object)


def train(docs, labels, id_col="doc_id", text_col="text", label="quality", sample=SAMPLE):
    """(weights, prior logit) from a bounded sample of the labelled documents; (None, 0) without labels of both kinds."""
    small_batches(docs.sparkSession)
    chosen = (labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(sample))
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).join(F.broadcast(chosen), "_id")
    rows = joined.select("_id", "_y", _features("_t").alias("x")).orderBy(F.xxhash64("_id"), "_id").limit(sample).collect()
    y = np.array([r["_y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None, 0.0
    return fit(np.array([r["x"] for r in rows]), y), float(np.log(y.mean() / (1 - y.mean())))


def _pseudo(groups, rate, prior, n):
    """Pseudo-counts of a level by the method of moments, from groups of n rows with a rate and the prior they shrink to."""
    row = groups.agg(
        F.sum(F.col(n) * (F.col(rate) - F.col(prior)) ** 2).alias("a"), F.count("*").alias("g"), F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("n2"),
        F.sum(F.col(n) * F.col(prior) * (1 - F.col(prior))).alias("v")).first()
    if not row.n or row.g < 2 or not row.v:
        return MOST_PSEUDO
    spread = row.v / row.n
    between = (row.a - (row.g - 1) * spread) / max(1e-9, row.n - row.n2 / row.n)
    return float(min(MOST_PSEUDO, max(LEAST_PSEUDO, spread / between - 1))) if between > 0 else MOST_PSEUDO


def classify(docs, labels, id_col="doc_id", text_col="text", host=None, path=None, keep_text=True):
    """docs plus evidence, host_rate, path_rate, posterior and kept. host and path: columns, by default source and lang.

    keep_text: whether the text is among the columns; without it less is saved.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    weights, prior = train(docs, labels, id_col, text_col)
    docs = docs.drop(*OUT)
    w = weights.tolist() if weights is not None else None

    @F.pandas_udf(T.DoubleType())
    def evidence(texts: pd.Series) -> pd.Series:
        if w is None:
            return pd.Series(np.zeros(len(texts)))
        x = np.array([features(t) for t in texts]).reshape(-1, len(w))
        return pd.Series(np.clip(np.round((x * np.array(w)).sum(axis=1) - prior, 6), -30, 30))

    h, p = free_name(docs, "host"), free_name(docs, "path")
    digest = lambda *c: F.unhex(F.md5(F.to_json(F.struct(*c))))  # noqa: E731  of fixed size, however long an address is
    keys = {h: digest(host.cast("string").alias("h")), p: digest(host.cast("string").alias("h"), path.cast("string").alias("p"))}
    scored = docs.withColumns(keys | {"evidence": evidence(F.col(text_col).cast("string"))})
    scored = written(scored, "evidence") if keep_text else saved(scored.drop(text_col))
    paths = _rates(scored.select(F.col(h).alias("host"), F.col(p).alias("path"), "evidence"), prior)
    out = scored.join(small(paths.withColumnRenamed("path", p)), p).drop(h, p)
    clipped = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("path_rate")))
    out = out.withColumn("posterior", F.round(1 / (1 + F.exp(-(F.col("evidence") + F.log(clipped / (1 - clipped))))), 6))
    return out.withColumn("kept", F.lit(True) if w is None else F.col("posterior") >= KEEP)


def _rates(scored, prior):
    """(path, host_rate, path_rate) of rows of host, path and evidence."""
    chance = F.round(1_000_000 / (1 + F.exp(-(F.col("evidence") + prior)))).cast("long")
    paths = saved(scored.select("host", "path", chance.alias("s")).groupBy("host", "path").agg(F.sum("s").alias("s"), F.count("*").alias("n")))
    total = paths.agg(F.sum("s"), F.sum("n")).first()
    overall = min(0.999, max(0.001, total[0] / 1e6 / total[1])) if total[1] else 0.5
    hosts = saved(paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn")).withColumns({"rate": F.col("hs") / 1e6 / F.col("hn"), "prior": F.lit(overall)}))
    kh = _pseudo(hosts, "rate", "prior", "hn")
    hosts = hosts.select("host", ((F.col("hs") / 1e6 + kh * overall) / (F.col("hn") + kh)).alias("host_rate"))
    paths = paths.join(hosts, "host").withColumn("rate", F.col("s") / 1e6 / F.col("n"))
    kp = _pseudo(paths, "rate", "host_rate", "n")
    return saved(paths.select("path", "host_rate", ((F.col("s") / 1e6 + kp * F.col("host_rate")) / (F.col("n") + kp)).alias("path_rate")))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return classify(docs, table(spark, sf_dir, "labels"), keep_text=False).select("doc_id", *OUT)


def stage(spark, docs, sf_dir):
    """The documents that stay, with their columns."""
    columns, aside = docs.columns, {}
    for c in columns:
        if c in OUT:
            aside[c] = free_name(docs, c)
            docs = docs.withColumnRenamed(c, aside[c])
    kept = classify(docs, table(spark, sf_dir, "labels")).where("kept")
    return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in columns])
