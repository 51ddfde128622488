"""Filters and searches over messages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions.text import preview
from threadmill.schema import ORDER


class BadDate(ValueError):
    """A date that isn't of the form yyyy-mm-dd."""


def parse_date(text: str | None) -> dt.date | None:
    if text is None:
        return None
    try:
        return dt.datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError as e:
        raise BadDate(f"{text!r} is no date of the form YYYY-MM-DD") from e


def in_date_range(messages: DataFrame, after=None, before=None, before_inclusive_day: bool = False) -> DataFrame:
    """Messages from midnight of ``after`` to midnight of ``before``, both included, in the session's time zone.

    So of the ``before`` day only its first millisecond counts, unless before_inclusive_day.
    """
    after, before = (parse_date(x) if isinstance(x, str) else x for x in (after, before))
    if after is not None:
        messages = messages.where(F.col("ts") >= F.lit(after.isoformat()).cast("date").cast("timestamp"))
    if before is not None:
        day = before + dt.timedelta(days=1) if before_inclusive_day else before
        limit = F.lit(day.isoformat()).cast("date").cast("timestamp")
        messages = messages.where(F.col("ts") < limit if before_inclusive_day else F.col("ts") <= limit)
    return messages


def search(messages: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """Messages whose content has the query as a substring."""
    text = F.col("content")
    return messages.where(F.contains(text, F.lit(query)) if case_sensitive else F.contains(F.lower(text), F.lower(F.lit(query))))


def search_report(messages: DataFrame, query: str, shown: int = 3, case_sensitive: bool = False) -> DataFrame:
    """The first matches of each thread: thread_key, n_matches, n_more, rank, dt_iso, sender, preview.

    Counts are aggregated before anything is ranked; ranks are cut by a limit a group, which Spark applies before the shuffle.
    """
    found = search(messages, query, case_sensitive)
    counts = found.groupBy("thread_key").agg(F.count("*").alias("n_matches"))
    rank = F.row_number().over(Window.partitionBy("thread_key").orderBy(*ORDER))
    first = found.withColumn("rank", rank).where(F.col("rank") <= shown)
    return first.join(counts, "thread_key").select(
        "thread_key", "n_matches", F.greatest(F.col("n_matches") - shown, F.lit(0)).alias("n_more"), "rank", "dt_iso", "sender", preview("content").alias("preview"))


def first_threads(threads: DataFrame, n: int) -> DataFrame:
    return threads.orderBy("thread_seq").limit(n)
