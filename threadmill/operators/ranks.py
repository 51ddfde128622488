"""Places in a global order, batches of it, and overlapping windows, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.session import free_name, saved


def with_place(df: DataFrame, *order, name: str = "place") -> DataFrame:
    """df plus each row's place (from 0) in the order given.

    Rows are dealt into ranges and sorted there; monotonically_increasing_id then has the range in its upper and the place
    within it in its lower bits. Only one count a range is gathered. The ranges are sampled, so they are fixed by a checkpoint.
    """
    row, part, count, offset = (free_name(df, x) for x in ("row", "part", "count", "offset"))
    ranged = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()))
    parts = ranged.groupBy(F.shiftright(row, 33).alias(part)).agg(F.count("*").alias(count))
    before = F.sum(count).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(count)
    offsets = F.broadcast(parts.select(part, before.alias(offset)))  # a row for each partition
    placed = ranged.withColumn(part, F.shiftright(row, 33)).join(offsets, part)
    return placed.withColumn(name, F.col(offset) + F.col(row).bitwiseAND(F.lit((1 << 33) - 1))).drop(row, part, offset)


def batches(df: DataFrame, *order, size: int) -> DataFrame:
    """df plus ``batch``, from 1: so many rows each, in the order given."""
    if size < 1:
        raise ValueError("a batch needs a row at least")
    return with_place(df, *order, name="_place").withColumn("batch", F.floor(F.col("_place") / size) + 1).drop("_place")


def window_count(height, chunk: int, overlap: int):
    """How many windows of ``chunk`` with ``overlap`` cover a height; the last may be short."""
    if chunk < 1 or not 0 <= overlap < chunk:
        raise ValueError("0 <= overlap < chunk is needed")
    h = F.col(height) if isinstance(height, str) else height
    return F.when(h <= chunk, F.lit(1).cast("long")).otherwise(1 + F.ceil((h - chunk) / (chunk - overlap)))


def windows(df: DataFrame, height: str, chunk: int, overlap: int) -> DataFrame:
    """A row for each window: index (from 1), top and bottom (exclusive)."""
    n = window_count(height, chunk, overlap)
    rows = df.withColumn("index", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    rows = rows.withColumn("top", (F.col("index") - 1) * (chunk - overlap))
    return rows.withColumn("bottom", F.least(F.col("top") + chunk, F.col(height).cast("long")))
