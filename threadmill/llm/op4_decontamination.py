"""Benchmark decontamination: template windows, hash-joined, with consistent slots. Built-in expressions only.

Texts of both sides become templates: tokens are lower-cased words, and numbers, names (capitalised words within a
sentence) and units (after a number) become typed placeholders. Windows of WINDOW template tokens with LITERALS words or
more that aren't placeholders are hashed; the documents' windows are joined to the benchmark's. A shared template only
counts if its slots agree over a run of matches: each of the item's slot values stands for one value of the document, as
where the question was re-parameterised throughout. The runs of a document and an item are the whole text, each diagonal
(matches whose places differ by the same number: a copy), and each occurrence (the longest diagonal at each place, until
the item's place goes back or the document's jumps by more than the item's length: a copy with words put in or left out).
Where a run's slots disagree, only its windows with the item's own values count, as a text can hold an item verbatim
beside other numbers. A document is contaminated if a run has COVER per cent or more of an item's windows; the item with
most cover is named.

Windows with fewer literals stand for their own values only, and are found verbatim. Cover is the greater of the shares of
all windows and of those with LITERALS words. Letters of scripts without spaces are tokens of their own. An item of
LITERALS tokens or more, but fewer than WINDOW, is one window of its length, found inside documents; one of fewer tokens
is too common a phrase and only equals a whole text.

The benchmark's windows are broadcast only if there are BROADCAST_ROWS of them or fewer, else both sides are shuffled; so are
the contaminated ids, up to BROADCAST_BAD. Only windows that match reach the grouped counting. Equal windows are found by 64-bit hashes.

Edge cases: null and empty texts have no windows and are clean; rows that share an id share the verdict; a null id is an id; of
items that cover equally the least id is named; an empty benchmark leaves all clean; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadmill.llm.common import free_name, let, saved, table

NAME = "op4_decontamination"
WINDOW, LITERALS, COVER = 5, 3, 50
BROADCAST_ROWS, BROADCAST_BAD = 1_000_000, 100_000
UNITS = ("kg g mg t km m cm mm l ml h min s ms hours hour minutes minute seconds second days day weeks week months month years year miles mile feet foot inches inch "
         "pounds pound dollars dollar euros euro cents cent percent % € £ $ ° usd eur gbp kmh mph degrees").split()
_NAME_MARK = "\x01"
_NAME = r"(?<=[\p{Ll}\p{N},;] )(?=\p{Lu})\p{Lu}[\p{L}'’]*"
#: Thai to Lao, Burmese, Khmer, kana and Han: scripts without spaces.
_UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
_TOKEN = r"\x01?\p{L}[\p{L}\p{M}]*|\p{N}+(?:[.,]\p{N}+)*|[%€£$°]"


def templates(df, id_col, text_col):
    """(id, raw, tpl): tokens, and the template of each."""
    text = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), f"({_NAME})", _NAME_MARK + "$1")
    text = let(text, lambda t: F.when(t.rlike(f"[{_UNSPACED}]"), F.regexp_replace(t, f"([{_UNSPACED}&&\\p{{L}}]\\p{{M}}*)", " $1 ")).otherwise(t))
    df = df.select(F.col(id_col).alias("id"), F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)).alias("raw"))
    numbered = F.exists("raw", lambda w: w.rlike(r"^\p{N}"))
    plain = lambda w: F.when(w.startswith(_NAME_MARK), "<name>").otherwise(F.lower(w))
    after = lambda i: F.coalesce(F.get(F.col("raw"), i - 1).rlike(r"^[\p{N}$€£]"), F.lit(False))
    full = lambda w, i: F.when(w.rlike(r"^\p{N}"), "<number>").when(F.lower(w).isin(UNITS) & after(i), "<unit>").otherwise(plain(w))
    return df.withColumn("tpl", F.when(numbered, F.transform("raw", full)).otherwise(F.transform("raw", plain)))


def windows(df, lengths=None):
    """(id, at, n, h, slots, exact): each window's place, its text's tokens, hash, slot values (null without slots) and
    whether it stands for its own values only.

    Without lengths a text of fewer than WINDOW tokens is one window of all of them; lengths are those of such windows to
    find in longer texts.
    """
    n = F.size("tpl")
    slotted = F.exists("tpl", lambda w: w.startswith("<"))
    literal = lambda i, k: F.size(F.filter(F.slice("tpl", i, k), lambda w: ~w.startswith("<")))
    values = lambda i, k: F.filter(F.slice("raw", i, k), lambda w, j: F.get(F.col("tpl"), i - 1 + j).startswith("<"))
    own = lambda i, k: F.transform(F.slice("raw", i, k), lambda w: F.lower(F.translate(w, _NAME_MARK, "")))
    none = F.lit(None).cast("array<string>")
    row = lambda i, h, slots, exact: F.struct(i.alias("at"), h.alias("h"), slots.alias("slots"), F.lit(exact).alias("exact"))
    bare = lambda i, k: row(i, F.xxhash64(F.slice("tpl", i, k)), none, False)
    rich = lambda i, k: row(i, F.xxhash64(F.slice("tpl", i, k)), values(i, k), False)
    either = lambda i, k: F.when(literal(i, k) >= LITERALS, rich(i, k)).otherwise(row(i, F.xxhash64(own(i, k)), none, True))
    empty = F.array().cast("array<struct<at:int,h:bigint,slots:array<string>,exact:boolean>>")

    def of(k):
        some = (n >= k) if k >= LITERALS else (n == k)
        at = F.when(some, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.when(slotted, F.transform(at, lambda i: either(i, F.lit(k)))).otherwise(F.transform(at, lambda i: bare(i, F.lit(k))))

    found = of(WINDOW)
    for k in range(1, WINDOW) if lengths is None else lengths:
        found = F.when(n == k, of(k)).otherwise(found) if lengths is None else F.concat(found, of(k))
    if lengths is None or lengths:
        whole = (n < WINDOW) & slotted & literal(F.lit(1), n).between(1, LITERALS - 1)
        found = F.concat(found, F.when(whole, F.array(rich(F.lit(1), n))).otherwise(empty))
    return df.select("id", n.alias("n"), F.explode(found).alias("w")).select("id", "n", "w.*")


def runs(found):
    """found once for each run that a match belongs to (see the top): the whole text, its diagonal, its occurrence."""
    pair = Window.partitionBy("id", "item_id")
    found = found.withColumn("diag", F.col("at") - F.col("item_at"))
    found = found.withColumn("_size", F.count("*").over(Window.partitionBy("id", "item_id", "diag")))
    found = found.withColumn("_best", F.min(F.struct(-F.col("_size"), "diag", "item_at")).over(Window.partitionBy("id", "item_id", "at")))
    found = found.withColumn("_best", (F.col("_best.diag") == F.col("diag")) & (F.col("_best.item_at") == F.col("item_at")))
    kept = Window.partitionBy("id", "item_id", "_best").orderBy("at")
    starts = (F.col("item_at") <= F.lag("item_at").over(kept)) | (F.col("at") - F.lag("at").over(kept) > F.col("n"))
    found = found.withColumn("_start", F.coalesce(starts, F.lit(False)).cast("int"))
    found = found.withColumn("_part", F.sum("_start").over(kept))
    run = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"))
    ways = [run(0, F.lit(0)), run(1, F.col("diag"))]
    ways = F.when(F.col("_best"), F.array(*ways, run(2, F.col("_part")))).otherwise(F.array(*ways))
    return found.withColumn("run", F.explode(ways)).drop("_size", "_best", "_start", "_part", "diag")


def contaminated(docs, benchmark, id_col="doc_id", text_col="text", item_col="item_id", item_text="text"):
    """(id, item_id, cover): the contaminated documents, the item each has most of, and how many per cent."""
    items = saved(windows(templates(benchmark, item_col, item_text)).select(F.col("id").alias("item_id"), "n", F.col("at").alias("item_at"), "h", F.col("slots").alias("item_slots"), "exact"))
    sizes = items.groupBy("item_id", "item_at").agg(F.bool_or(~F.col("exact")).alias("rich")).groupBy("item_id").agg(F.count("*").alias("n"), F.count_if("rich").alias("n_rich"))
    lengths = sorted(r.n for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())
    small = items.count() <= BROADCAST_ROWS
    found = windows(templates(docs, id_col, text_col), lengths).drop("n", "exact").join(F.broadcast(items) if small else items, "h")
    found = saved(found.select("id", "at", "item_id", "item_at", "n", "exact", "slots", "item_slots", (F.col("exact") | F.col("slots").eqNullSafe(F.col("item_slots"))).alias("verbatim")))
    found, key = runs(found), ["id", "item_id", "run"]
    pairs = found.where(F.size("slots") > 0).select(*key, F.explode(F.arrays_zip(F.col("item_slots").alias("was"), F.col("slots").alias("now"))).alias("p"))
    odd = pairs.groupBy(*key, "p.was").agg((F.min("p.now") < F.max("p.now")).alias("odd")).where("odd").select(*key, "odd").distinct()
    same = (F.col("l.id").eqNullSafe(F.col("r.id"))) & (F.col("l.item_id").eqNullSafe(F.col("r.item_id"))) & (F.col("l.run") == F.col("r.run"))
    rich = ~F.col("exact")
    at = found.groupBy(*key, "item_at").agg(F.bool_or("verbatim").alias("same"), F.bool_or(rich).alias("rich"), F.bool_or(F.col("verbatim") & rich).alias("same_rich"))
    counts = at.groupBy(*key).agg(F.count("*").alias("all"), *[F.count_if(c).alias(c) for c in ("rich", "same", "same_rich")])
    odd_or = lambda a, b: F.when(F.col("r.odd"), F.col(f"l.{a}")).otherwise(F.col(f"l.{b}"))
    counts = counts.alias("l").join(odd.alias("r"), same, "left").select("l.id", "l.item_id", odd_or("same", "all").alias("m"), odd_or("same_rich", "rich").alias("m_rich"))
    part = lambda m, n: F.when(F.col(n) > 0, 100 * F.col(m) / F.col(n))
    counts = counts.alias("l").join(sizes.alias("r"), F.col("l.item_id").eqNullSafe(F.col("r.item_id"))).select("l.id", "l.item_id", F.greatest(part("m", "n"), part("m_rich", "n_rich")).alias("cover"))
    best = F.min(F.struct((-F.col("cover")).alias("less"), "item_id"))
    return counts.where(F.col("cover") >= COVER).groupBy("id").agg(best.alias("b")).select("id", "b.item_id", (-F.col("b.less")).alias("cover"))


def decontaminate(docs, benchmark, id_col="doc_id"):
    """docs plus contaminated (boolean), bench_item and cover (null where clean)."""
    docs = docs.drop("contaminated", "bench_item", "cover")
    key = free_name(docs, "id")
    bad = saved(contaminated(docs, benchmark, id_col)).select(F.col("id").alias(key), F.col("item_id").alias("bench_item"), "cover")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_BAD else bad
    out = docs.join(bad, F.col(id_col).eqNullSafe(F.col(key)) & (F.col("cover") > 0), "left")
    return out.withColumn("contaminated", F.col("cover").isNotNull()).drop(key)


def query(spark, sf_dir):
    return of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def of(docs, benchmark):
    return decontaminate(docs.select("doc_id", "text"), benchmark).select("doc_id", "contaminated", F.col("bench_item").alias("item_id"), F.round("cover", 4).alias("cover"))


def stage(spark, docs, sf_dir):
    """The documents that are clean, with their columns."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)
