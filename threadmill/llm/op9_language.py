"""Language identification by Bayesian evidence fusion: text, declared markup language, address suffix and host.

The text's likelihood is a unigram model of words, with a letter-trigram model of the same words behind it for those it
doesn't know; it is counted on the SAMPLE labelled documents whose digest of the id is least (a documented bound) and
keeps the VOCABULARY most frequent (word, language) pairs and the OWN_WORDS most frequent words of each language, of all languages. Words are scored whole, in pieces of PIECE letters; a piece's evidence is bounded, and a text counts as TEXT_WORDS
words at most, since its words aren't independent. The texts' posteriors are then summed, over all rows, by address suffix,
by host and by declared language; a suffix's rates are shrunk to the global ones, a host's to its suffix's, and a declared
language counts as an observation with the rate at which it goes with each language. The fused posterior is the product.

Sums are of whole millionths, so results don't depend on the order of rows. Sums go by the three keys together, and the
rates go back to the rows by one digest of them: in one join, broadcast if the rates are few, else split at hot keys.

Edge cases: a null or empty text says nothing and leaves the other evidence; null or odd addresses and declarations are
groups of their own; ties go to the first language by name; equal rows get equal results; without labelled rows the
language is null; an empty table gives no rows; further columns, whatever their names, pass through ``identify`` and its
outputs replace columns of their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm.common import free_name, saved, small, small_batches, table, word_array

NAME = "op9_language"
SAMPLE, VOCABULARY, OWN_WORDS = 10_000, 40_000, 1_000
TEXT_WORDS, WORD_BOUND = 50, 6.0
#: Pseudo-counts by which suffixes, hosts and declarations are shrunk.
PSEUDO = 20.0
#: Letters of a word that are scored as one; longer words, as in scripts without spaces, count as several.
PIECE = 40
_PIECES = f"CASE WHEN length(w) <= {PIECE} THEN array(w) ELSE transform(sequence(0, (length(w) - 1) div {PIECE}), k -> substring(w, int(k) * {PIECE} + 1, {PIECE} + 2)) END"
_MARKS = ".,;:!?\"'()[]{}*#$%&|<>+-=/0123456789"


def train(docs, sample=SAMPLE, id_col="doc_id", text_col="text", lang_col="lang"):
    """(languages, {word: log-likelihoods}, {trigram: log-likelihoods}) from a bounded sample of labelled rows."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.lower(F.col(text_col).cast("string")).alias("t")).join(F.broadcast(rows), "_id")
    word = F.regexp_replace("w", r"^[^\p{L}]+|[^\p{L}]+$", "")
    counts = chosen.select("lang", F.explode(word_array(F.col("t"))).alias("w")).select("lang", word.alias("w")).select("lang", F.explode(F.expr(_PIECES)).alias("w")).where("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("c"))
    counts = saved(counts)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "w"))
    own = counts.withColumn("_r", rank).where(F.col("_r") <= OWN_WORDS).drop("_r").collect()
    often = counts.orderBy(F.desc("c"), "w", "lang").limit(VOCABULARY).collect()
    return model(sorted({(r["lang"], r["w"]): r for r in often + own}.values(), key=lambda r: (-r["c"], r["w"], r["lang"])))


def model(rows):
    """The tables of (lang, w, c) rows."""
    total = Counter()
    for r in rows:
        total[r["lang"]] += r["c"]
    langs = sorted(total)
    place = {x: k for k, x in enumerate(langs)}
    words, grams = defaultdict(lambda: np.zeros(len(langs))), defaultdict(lambda: np.zeros(len(langs)))
    for r in rows:
        k = place[r["lang"]]
        words[r["w"]][k] += r["c"]
        for g in trigrams(r["w"]):
            grams[g][k] += math.sqrt(r["c"])

    def logs(table):
        n = sum(table.values(), np.zeros(len(langs)))
        return {x: np.log((v + 0.5) / (n + 0.5 * len(table) + 1)) for x, v in table.items()}

    return langs, logs(words), logs(grams)


def pieces(word):
    """The word between blanks, in pieces that share two letters: each trigram is in one of them."""
    padded = f" {word} "
    return [padded[i:i + PIECE + 2] for i in range(0, max(1, len(word)), PIECE)]


def trigrams(word):
    return [p[i:i + 3] for p in pieces(word) for i in range(len(p) - 2)]


def _centred(v):
    """Rows of log-likelihoods against their largest, bounded."""
    return np.clip(v - v.max(axis=1, keepdims=True), -WORD_BOUND, 0) if len(v) else v


class Likelihoods:
    """Log-likelihoods of whole texts, up to a constant each.

    Words of the vocabulary are rows of a table; of the others, which a text may have any number of, only the trigrams
    are looked up, MOST_AT_ONCE words at a time.
    """

    MOST_KEPT, MOST_AT_ONCE = 100_000, 10_000

    def __init__(self, langs, words, grams):
        self.n, self.words, self.grams = len(langs), {w: k for k, w in enumerate(words, 1)}, {g: k for k, g in enumerate(grams)}
        self.said = np.vstack([np.zeros((1, self.n)), _centred(np.array(list(words.values())).reshape(-1, self.n))])  # row 0: bare marks
        self.gram_said = np.array(list(grams.values())).reshape(-1, self.n)
        self.at = dict(self.words)

    def _rows(self, tokens):
        """(table rows of the tokens that have one, the other tokens without marks)."""
        rows = list(map(self.at.get, tokens))
        if None not in rows:
            return rows, []
        known, others = [], []
        for token, k in zip(tokens, rows, strict=True):
            if k is None:
                w = token.strip(_MARKS)
                k = self.words.get(w) if w else 0
                if k is None:
                    others.append(w)
                    continue
                if len(self.at) < self.MOST_KEPT:
                    self.at[token] = k
            known.append(k)
        return known, others

    def _by_grams(self, others):
        get, flat, ends = self.grams.get, [], []
        for w in others:
            for p in pieces(w):
                flat += [k for k in map(get, map("".join, zip(p, p[1:], p[2:], strict=False))) if k is not None]
                ends.append(len(flat))
        if not flat:
            return np.zeros(self.n)
        starts = np.array([0, *ends[:-1]])
        some = starts < np.array(ends)
        sums = np.add.reduceat(self.gram_said[flat], starts[some], axis=0) / 2
        return _centred(sums).sum(axis=0)

    def __call__(self, text: str | None) -> np.ndarray:
        known, others = self._rows((text or "").lower().split())
        total = self.said[known].sum(axis=0) if known else np.zeros(self.n)
        for i in range(0, len(others), self.MOST_AT_ONCE):
            total = total + self._by_grams(others[i:i + self.MOST_AT_ONCE])
        return total * min(1.0, TEXT_WORDS / max(1, np.count_nonzero(known) + sum(max(1, -(-len(w) // PIECE)) for w in others)))


def identify(rows, trained, text="text", declared="declared", suffix="suffix", host="host"):
    """rows plus language, confidence and text_language."""
    langs, words, grams = trained
    rows = rows.drop("language", "confidence", "text_language")
    if not langs:
        return rows.withColumns({"language": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "text_language": F.lit(None).cast("string")})
    small_batches(rows.sparkSession)
    n = len(langs)
    sent = rows.sparkSession.sparkContext.broadcast(Likelihoods(langs, words, grams))  # bounded by VOCABULARY and OWN_WORDS

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = sent.value
        for texts in batches:
            yield pd.Series([np.round(of(t), 6) for t in texts], dtype=object)

    ll, d, s, h, key, prior, dr, p = (free_name(rows, x) for x in ("ll", "declared", "suffix", "host", "key", "prior", "spoken", "p"))
    keyed = rows.withColumns({
        ll: score(F.col(text).cast("string")), d: F.lower(F.split(F.coalesce(F.col(declared), F.lit("")), "[-_]")[0]),
        s: F.lower(F.coalesce(F.col(suffix), F.lit(""))), h: F.lower(F.coalesce(F.col(host), F.lit("")))}).drop(text)
    keyed = saved(keyed.withColumn(key, F.unhex(F.md5(F.to_json(F.struct(d, s, h))))))
    sent.unpersist()  # the checkpoint has all that it was for
    top = lambda a: F.element_at(F.filter(F.lit(langs), lambda x, i: F.get(a, i) == F.array_max(a)), 1)

    def softmax(a):
        e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))

    said = F.exists(ll, lambda x: x != 0)
    cols = [f"c{i}" for i in range(n)]
    post = keyed.select(F.col(key).alias("k"), F.col(d).alias("d"), F.col(s).alias("s"), F.col(h).alias("h"), F.when(said, softmax(F.col(ll))).alias("p"))
    by = post.groupBy("k").agg(*[F.min(x).alias(x) for x in "dsh"], *[F.coalesce(F.sum(F.round(F.get("p", F.lit(i)) * 1_000_000).cast("long")), F.lit(0)).alias(c) for i, c in enumerate(cols)])
    rates = small(saved(_rates(saved(by), cols)).select(F.col("k").alias(key), F.col("prior").alias(prior), F.col("spoken").alias(dr)))
    fused = F.transform(ll, lambda x, i: x + F.log(F.get(F.col(prior), i)) + F.get(F.col(dr), i))
    out = keyed.join(rates, key).withColumn(p, fused).withColumn(p, softmax(F.col(p)))
    out = out.withColumns({"language": top(F.col(p)), "confidence": F.round(F.array_max(p), 6), "text_language": F.when(said, top(F.col(ll)))})
    return out.drop(ll, d, s, h, key, prior, dr, p)


def _rates(by, cols):
    """(k, prior, spoken) for the groups of declared language d, suffix s and host h with their sums: the host's shrunk rates,
    and the logarithms of the declared language's rates against the global ones."""
    counts = lambda *keys: by.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols])
    whole = by.agg(*[F.sum(c) for c in cols]).first()
    mass = sum(x or 0 for x in whole)
    overall = [((x or 0) + 1) / (mass + len(cols)) for x in whole]
    rate = lambda prior: F.array(*[(F.col(c) / 1e6 + PSEUDO * p) / (sum(F.col(k) for k in cols) / 1e6 + PSEUDO) for c, p in zip(cols, prior, strict=True)])
    global_rate = rate([F.lit(p) for p in overall])
    suffixes = small(saved(counts("s").select("s", global_rate.alias("sr"))))
    hosts = saved(saved(counts("s", "h")).join(suffixes, "s").select("s", "h", rate([F.get("sr", F.lit(i)) for i in range(len(cols))]).alias("prior")))
    # P(declared | language) up to the language's total, which the declared rate against the global one gives
    against = F.array(*[F.when(F.col("d") == "", 0.0).otherwise(F.log(F.get(global_rate, F.lit(i)) / F.lit(p))) for i, p in enumerate(overall)])
    spoken = small(saved(counts("d").select("d", against.alias("spoken"))))
    return by.join(small(hosts), ["s", "h"]).join(spoken, "d").select("k", "prior", "spoken")


def markup_text(html):
    """The text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, "&[A-Za-z]{2,8};|&#[0-9]{1,7};", " ")


def evidence_rows(docs, pages):
    """Documents (host: their source) and pages as rows of kind, id, text, declared, suffix, host."""
    none = F.lit(None).cast("string")
    docs = docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), none.alias("declared"), none.alias("suffix"), F.col("source").cast("string").alias("host"))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z]+://([^/?#:]+)", 1))
    suffix = F.regexp_extract(host, r"\.([a-z]+)$", 1)
    place = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z]+://[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    lang = F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    pages = pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), markup_text(html).alias("text"), lang.alias("declared"), F.concat_ws("/", suffix, place).alias("suffix"), host.alias("host"))
    return docs.unionByName(pages)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(evidence_rows(docs, table(spark, sf_dir, "pages")), train(docs))
    return found.select(
        "kind", F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"), F.when(F.col("kind") == "page", F.col("id")).alias("page_id"), "language", "confidence", "text_language")
