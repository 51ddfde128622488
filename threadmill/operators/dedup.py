"""Duplicate threads, merging, first-wins deduplication and unique thread ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions.hashing import participant_signature
from threadmill.functions.text import slugify
from threadmill.schema import MESSAGES, ORDER, THREADS

#: Characters of a content that tell two messages apart when threads are merged.
MERGE_PREFIX = 50
#: Files that a thread has fewer of: places of merged threads are multiples of it, in longs.
FILES_OF_A_THREAD = 1 << 32


def first_of(df: DataFrame, keys, order) -> DataFrame:
    """The first row of each key in the order given. Spark cuts the ranks within each task before it shuffles."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def signed(threads: DataFrame) -> DataFrame:
    return threads.withColumn("signature", participant_signature("participants"))


def duplicate_threads(threads: DataFrame) -> DataFrame:
    """The threads whose participants, case aside, are those of another one: signature, n_threads and the thread's columns."""
    rows = signed(threads).where("signature <> ''")
    counts = rows.groupBy("signature").agg(F.count("*").alias("n_threads")).where("n_threads > 1")
    return rows.join(counts, "signature")


def duplicate_groups(threads: DataFrame) -> DataFrame:
    """A row for each group of duplicate threads: participants (title-cased), n_threads, thread_keys in order."""
    rows = duplicate_threads(threads)
    grouped = rows.groupBy("signature").agg(F.first("n_threads").alias("n_threads"), F.array_sort(F.collect_list("thread_key")).alias("thread_keys"))
    return grouped.select(F.array_join(F.transform(F.split("signature", "\x1f"), _title), ", ").alias("participants"), "n_threads", "thread_keys")


def _title(name):
    """Each run of letters with a capital first letter."""
    parts = F.regexp_extract_all(name, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def merge(threads: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Duplicate threads joined into the first of each group; others as they are. -> (threads, messages)

    The merged thread has the first title that isn't empty and all participants; of messages with equal time, sender and
    first characters the one of the earliest thread stays.
    """
    sig = signed(threads)
    group = F.when(F.col("signature") == "", F.concat(F.lit("\x1e"), F.col("thread_key"))).otherwise(F.col("signature"))
    sig = sig.withColumn("_g", group)
    first = sig.groupBy("_g").agg(F.min(F.struct("thread_seq", "thread_key", "source_id", "source_seq")).alias("x"), F.min(F.when(F.trim("title") != "", F.struct("thread_seq", "title"))).alias("t"),
                                  F.array_sort(F.array_distinct(F.flatten(F.collect_list("participants")))).alias("participants"))
    merged = first.select("_g", "x.thread_key", "x.source_id", "x.source_seq", "x.thread_seq", F.coalesce("t.title", F.lit("")).alias("title"), "participants")
    names = sig.select("thread_key", F.col("thread_seq").alias("_seq"), "_g").join(merged.select("_g", F.col("thread_key").alias("_to")), "_g").drop("_g")
    rows = messages.join(names, "thread_key")
    kept = first_of(rows.withColumn("_p", F.substring("content", 1, MERGE_PREFIX)), ["_to", "timestamp_ms", "sender", "_p"], ["_seq", *ORDER])
    # places in the merged thread: by time, then by the thread that a message came from
    kept = kept.withColumns({"thread_key": F.col("_to"), "file_seq": F.col("_seq").cast("long") * FILES_OF_A_THREAD + F.col("file_seq")})
    return merged.select(*THREADS.names), kept.select(*MESSAGES.names)


def _unique(batches):
    """Rows sorted by root and place -> with their ids. All ids that can collide share a root."""
    root, used, following = None, set(), {}
    for batch in batches:
        ids = []
        for r, base in zip(batch["_root"], batch["base"], strict=True):
            if r != root:
                root, used, following = r, set(), {}
            new = base
            if base in used:
                n = following.get(base, 2)
                while (new := f"{base}_{n}") in used:
                    n += 1
                following[base] = n + 1
            used.add(new)
            ids.append(new)
        yield batch.assign(thread_id=pd.Series(ids, index=batch.index, dtype=object)).drop(columns=["_root"])


def unique_ids(df: DataFrame, key: str, base, order: str) -> DataFrame:
    """(key, base, thread_id): the base where it is free, else with the first free number from _2 on, in the order given.

    An id can only collide with ids of the same root (the base without its number endings), so each root is one sorted run.
    """
    rows = df.select(F.col(key).alias("key"), base.alias("base"), F.col(order).alias("_order"))
    rows = rows.withColumn("_root", F.regexp_replace("base", r"(?:_\d+)+\z", ""))
    rows = rows.repartition("_root").sortWithinPartitions("_root", "_order", "key")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "base", "_root").mapInPandas(_unique, f"key {kind}, base string, thread_id string").withColumnRenamed("key", key)


def thread_ids(threads: DataFrame) -> DataFrame:
    """threads plus thread_id, a unique file name made of the title (of the thread's key where that gives none)."""
    last = F.regexp_extract("thread_key", r"([^/]*)\z", 1)
    base = F.coalesce(F.nullif(slugify("title"), F.lit("")), F.nullif(slugify(last), F.lit("")), F.lit("thread"))
    return threads.join(unique_ids(threads, "thread_key", base, "thread_seq").drop("base"), "thread_key")

