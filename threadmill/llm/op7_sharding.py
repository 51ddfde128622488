"""Proportional stratified interleaving: every shard gets the mixture of the sources.

Rows are shuffled by a seeded digest of their id and ranked within their source; row r of a source of n rows gets the
fractional rank (2r - 1) / 2n. In the order of fractional ranks every stretch holds the sources in their overall
proportions, so the order is cut into shards whose row counts differ by one at most (law ``rows``).

Neither ranking gathers a source, a rank or equal rows in a task: rows are dealt into ranges of (source, digest, ...), then
of (fractional rank, source, rank), both made unique by the row's number in the saved input; a row's place is the count of
the ranges before plus its place in its range. The text is read once and doesn't travel.

Edge cases: a null source is a source of its own; a null text has size 16 and CRC 0; equal rows (even of one id) each
get a slot of their own; null ids have one digest and are told apart by the row's number; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill.llm.common import free_name, saved, small, table
from threadmill.operators.ranks import with_place

NAME = "op7_sharding"
SHARDS, SEED = 40, "threadmill"
#: The leading digits of the digest taken as a number, in bits.
BITS = 60


def interleave(df, id_col="doc_id", source_col="source", shards=SHARDS, seed=SEED):
    """df's columns (shard and slot excepted) plus shard (int) and slot (long, gapless from 0 in each shard)."""
    df = df.drop("shard", "slot")
    columns = df.columns
    digest, source, row, place, n, first, part, shard = (free_name(df, x) for x in ("digest", "source", "row", "place", "n", "first", "part", "shard"))
    df = saved(df.withColumns({
        digest: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))), 1, BITS // 4), 16, 10).cast("long"),
        source: F.to_json(F.struct(F.col(source_col).alias("source"))), row: F.monotonically_increasing_id()}))
    total = max(1, df.count())
    placed = with_place(df, source, digest, id_col, row, name=place)
    sources = saved(placed.groupBy(source).agg(F.count("*").alias(n), F.min(place).alias(first)))
    rank = F.col(place) - F.col(first) + 1
    ranked = placed.join(small(sources), source).withColumns({place: rank, part: (2 * rank - 1) / (2 * F.col(n)).cast("double")})
    ranked = saved(ranked.select(*columns, source, place, part))
    cut = with_place(ranked, part, source, place, name=first)
    cut = cut.withColumn(shard, F.expr(f"(`{first}` * {shards}L) div {total}L"))
    slot = F.col(first) - F.expr(f"(`{shard}` * {total}L + {shards - 1}L) div {shards}L")
    return cut.select(*columns, F.col(shard).cast("int").alias("shard"), slot.alias("slot"))


def query(spark, sf_dir):
    return of(table(spark, sf_dir, "documents"))


def of(docs):
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return interleave(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
