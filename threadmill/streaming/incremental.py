"""Incremental runs: only folders whose files changed are read again.

The store is a folder with ``messages`` and ``threads`` (Parquet, a folder for each run) and ``ledger`` (path and SHA-256 of the
whole content of every file read; no hash for a file that went). A thread's newest run is its state, and a thread without files
has none; ``current`` reads them, and numbers the threads by source and key, whichever run each comes from. ``stream`` does the same from a
file stream with a checkpoint, for exports that keep arriving as new files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions.hashing import content_hash
from threadmill.operators.ranks import with_place
from threadmill.schema import MESSAGES, THREADS
from threadmill.sources import repair
from threadmill.sources.export_reader import discover, list_files, messages_of, threads_of

LEDGER = "path string, thread_key string, hash string, run long, source_id string, attempt string"


def _read(spark: SparkSession, store: str, name: str, schema) -> DataFrame:
    from threadmill.sinks.files import file_system

    system, root = file_system(store)
    if not system.get_file_info(f"{root}/{name}").type.name == "Directory":
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{store}/{name}")


def _run_schema(schema):
    return schema.add("run", "long") if "run" not in schema.names else schema


def update(spark: SparkSession, root: str, store: str, source_id: str = "archive", source_seq: int = 0) -> dict:
    """Reads what is new, changed or gone below root; {run, changed threads, unchanged files}. A run that fails part way changes
    nothing that ``current`` reads: the ledger is written last, and only its runs count."""
    ledger = _read(spark, store, "ledger", LEDGER)
    last = ledger.agg(F.max("run")).first()[0]
    run = (last or 0) + 1
    files = discover(list_files(spark, root, source_id, source_seq)).withColumn("hash", content_hash("raw")).persist()
    known = ledger.where(F.col("source_id") == source_id).groupBy("path", "thread_key").agg(F.max_by("hash", "run").alias("was")).where("was is not null")
    both = files.select("path", "thread_key", "hash").join(known, ["path", "thread_key"], "full").persist()
    changed = both.where("not (was <=> hash)").select("thread_key").distinct().persist()
    n_changed, n_same = changed.count(), both.where("was = hash").count()  # before the ledger grows
    if n_changed:
        parsed = repair.load(files.join(changed, "thread_key", "left_semi")).where("data is not null")
        attempt = uuid.uuid4().hex  # leftovers of a failed run have another attempt's name
        messages_of(parsed).withColumns({"run": F.lit(run).cast("long")}).write.mode("append").option("maxRecordsPerFile", 5_000_000).parquet(f"{store}/messages/attempt={attempt}")
        threads_of(parsed).withColumn("run", F.lit(run).cast("long")).write.mode("append").parquet(f"{store}/threads/attempt={attempt}")
        rows = both.join(changed, "thread_key", "left_semi").select("path", "thread_key", "hash", F.lit(run).cast("long").alias("run"), F.lit(source_id).alias("source_id"), F.lit(attempt).alias("attempt"))
        rows.write.mode("append").parquet(f"{store}/ledger")
    out = {"run": run if n_changed else last or 0, "changed_threads": n_changed, "unchanged_files": n_same}
    for x in (files, both, changed):
        x.unpersist()
    return out


def current(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """(threads, messages) of the newest run of each thread."""
    ledger = _read(spark, store, "ledger", LEDGER)
    newest = ledger.groupBy("thread_key").agg(F.max("run").alias("run"), F.max_by("attempt", "run").alias("attempt"))
    threads = _read(spark, store, "threads", _run_schema(_copy(THREADS)).add("attempt", "string")).join(newest, ["thread_key", "run", "attempt"], "left_semi")
    messages = _read(spark, store, "messages", _run_schema(_copy(MESSAGES)).add("attempt", "string")).join(newest, ["thread_key", "run", "attempt"], "left_semi")
    placed = with_place(threads.drop("run", "attempt", "thread_seq"), "source_seq", "source_id", "thread_key", name="thread_seq")
    return placed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in THREADS]), messages.drop("run", "attempt")


def _copy(schema):
    return type(schema)(list(schema.fields))


def stats_of(spark: SparkSession, store: str) -> DataFrame:
    """Entries, files, runs and megabytes of the store, and the share of files that the last run found unchanged."""
    from threadmill.sinks.files import file_system

    ledger = _read(spark, store, "ledger", LEDGER)
    system, root = file_system(store)
    from pyarrow import fs

    size = sum(x.size or 0 for x in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)))
    last = ledger.agg(F.max("run")).first()[0]
    live = ledger.groupBy("path").agg(F.max_by("hash", "run").alias("hash"), F.max("run").alias("run")).where("hash is not null")
    rows = ledger.agg(F.count("*").alias("entries"), F.count_distinct("path").alias("files"), F.count_distinct("run").alias("runs"), F.lit(size / 2**20).alias("mb"))
    hits = live.agg(F.coalesce(F.count_if(F.col("run") < (last or 0)) / F.count("*"), F.lit(0.0)).alias("hit_rate"))
    return rows.crossJoin(hits)  # a row each


def stream(spark: SparkSession, root: str, store: str, checkpoint: str, source_id: str = "stream", available_now: bool = True):
    """A streaming query that appends the cleaned messages of each new file below root to ``store``, partitioned by month.

    Files are threads by folder; file_seq follows the files' names, as ``message_<n>`` parts arrive in any order. With
    available_now it stops once all files are read; the checkpoint makes the next call go on from there, and after a failure a
    micro-batch is written again under the same batch id, whose folder it replaces.
    """
    files = spark.readStream.schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root)
    files = files.select(
        F.col("value").alias("raw"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"))

    def write(batch: DataFrame, batch_id: int) -> None:
        seq = F.coalesce(F.expr("try_cast(regexp_extract(name, '([0-9]+)[.]json$', 1) AS INT)"), F.lit(0))
        rows = batch.withColumns({"thread_key": F.regexp_replace("path", r"/[^/]*\z", ""), "source_id": F.lit(source_id), "source_seq": F.lit(0), "file_seq": seq})
        messages = messages_of(repair.load(rows).where("data is not null"))
        messages.withColumn("month", F.substring("dt_iso", 1, 7)).write.mode("overwrite").partitionBy("month").parquet(f"{store}/batch={batch_id}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def hourly_counts(messages: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Messages by window and sender; on a stream, windows are final once the watermark has passed them."""
    return messages.withWatermark("ts", late).groupBy(F.window("ts", window), "sender").agg(F.count("*").alias("n_messages")).select("window.start", "window.end", "sender", "n_messages")
