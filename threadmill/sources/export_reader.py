"""Chat exports as DataFrames: discovery of thread folders and files, repair, and the cleaned messages of all threads.

Everything is one scan of whole files: folders, patterns and fallbacks are columns of the file listing, so no file is listed or
opened on the driver. A file's messages are exploded where it is read; only the small per-folder facts are aggregated.

Sizes: a file is a row, so it must fit in a task's memory (exports are cut into parts of some MB by their maker).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.functions.attachments import attachment_details, attachment_summary, has_payload, reaction_summary
from threadmill.functions.text import clean_text, is_blank, iso_seconds, safe_str
from threadmill.operators.filters import in_date_range
from threadmill.operators.ranks import with_place
from threadmill.schema import MESSAGES, REJECTS, THREADS
from threadmill.sources import repair

# File names of exports, and how much of a file is looked at to tell a conversation.
PART, LOGS, E2EE = r"message_[^/]*\.json\z", r"[^/]*messenger_logs[^/]*\.json\z", r"[^/]*_messages[^/]*\.json\z"
SNIFFED, NAMED_IN_TITLE = 500, 4


@dataclass(frozen=True)
class Archive:
    """What ``read_archive`` gives: threads, their messages, and what was rejected or repaired."""

    threads: DataFrame
    messages: DataFrame
    rejects: DataFrame
    fixes: DataFrame


def list_files(spark: SparkSession, root: str, source_id: str | None = None, source_seq: int = 0) -> DataFrame:
    """A row for each JSON file below root: path, dir, name, raw, size, source_id, source_seq, top (whether it is in root itself)."""
    files = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").format("binaryFile").load(root)
             .select(F.col("path"), F.col("content"), F.col("length").alias("size")))
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    raw = F.coalesce(utf8, F.decode(F.col("content"), "ISO-8859-1"))  # files that aren't UTF-8 are taken as Latin-1
    plain = F.regexp_replace(F.lit(root), r"\A[A-Za-z0-9+.\-]+:/*|\A/+|/+\z", "")
    folder = F.regexp_replace("path", r"/[^/]*\z", "")
    return files.select(
        "path", folder.alias("dir"), F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), raw.alias("raw"), utf8.isNull().alias("latin1"), "size",
        F.lit(source_id or root).alias("source_id"), F.lit(source_seq).alias("source_seq"), F.endswith(folder, plain).alias("top"))


def discover(files: DataFrame) -> DataFrame:
    """The files of threads, with thread_key, standalone and file_seq (their place among the thread's files, by name).

    A folder with ``message_*.json`` is a thread of those; a folder with only encrypted-export names one of all its JSON files.
    The root is a thread only if nothing below is one (then not by the ``_messages`` names), and its other files are threads of
    their own if their beginning mentions participants or messages.
    """
    listed = files.withColumns({"_part": F.col("name").rlike(r"\A" + PART), "_logs": F.col("name").rlike(r"\A" + LOGS), "_e2ee": F.col("name").rlike(r"\A" + E2EE)})
    folders = listed.groupBy("source_id", "dir").agg(
        F.bool_or("_part").alias("has_part"), F.bool_or(F.col("_logs")).alias("has_logs"), F.bool_or("_e2ee").alias("has_e2ee"), F.bool_or("top").alias("is_top"))
    below = folders.groupBy("source_id").agg(F.bool_or(~F.col("is_top") & (F.col("has_part") | F.col("has_logs") | F.col("has_e2ee"))).alias("any_below"))
    folders = folders.join(below, "source_id").select(
        "source_id", "dir", "has_part",
        F.when(F.col("is_top"), ~F.col("any_below") & (F.col("has_part") | F.col("has_logs"))).otherwise(F.col("has_part") | F.col("has_logs") | F.col("has_e2ee")).alias("is_thread"))
    marked = listed.join(folders, ["source_id", "dir"])
    head = F.substring("raw", 1, SNIFFED)
    in_thread = F.col("is_thread") & (F.col("_part") | ~F.col("has_part"))
    alone = F.col("top") & ~F.col("_part") & (F.contains(head, F.lit('"participants"')) | F.contains(head, F.lit('"messages"')))
    kinds = F.filter(F.array(F.when(in_thread, F.lit(False)), F.when(alone, F.lit(True))), lambda x: x.isNotNull())
    found = marked.withColumn("standalone", F.explode(kinds)).withColumn("thread_key", F.when(F.col("standalone"), F.col("path")).otherwise(F.col("dir")))
    seq = F.row_number().over(Window.partitionBy("source_id", "thread_key").orderBy("name")) - 1
    return found.withColumn("file_seq", seq).drop("_part", "_logs", "_e2ee", "has_part", "is_thread")


def participants_of(column):
    """Cleaned names of objects or strings, sorted and distinct; anything else is dropped."""
    name = lambda p: F.when(p.rlike(r"\A\s*\{"), F.get_json_object(p, "$.name")).when(~p.rlike(r"\A\s*\["), p)
    names = F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda p: clean_text(name(p), entities=False))
    return F.filter(names, lambda n: n != "")


def messages_of(parsed: DataFrame) -> DataFrame:
    """The cleaned messages of parsed files. Rows without a time, and those without text, attachment and reaction, go."""
    rows = parsed.select("thread_key", "source_id", "source_seq", "file_seq", F.posexplode("data.messages").alias("msg_idx", "m")).where("m is not null")
    # numbers of JSON come as their text, fractions as doubles'; both are truncated. A fraction in a string can't be told from one.
    ms = F.expr("CASE t WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE coalesce(try_cast(t AS BIGINT), try_cast(try_cast(t AS DECIMAL(38, 4)) AS BIGINT)) END")
    rows = rows.withColumn("t", F.expr("trim(coalesce(m.timestamp_ms, m.timestamp))"))
    sender = clean_text(F.coalesce(F.nullif(F.col("m.sender_name"), F.lit("")), F.col("m.senderName")))
    rows = rows.withColumn("timestamp_ms", ms).where("timestamp_ms is not null").withColumns({
        "_sender": sender, "content": clean_text(F.coalesce(F.col("m.content"), F.col("m.text"))), "reactions": reaction_summary("m.reactions"),
        "attachments": attachment_summary("m"), "attachment_details": attachment_details("m")})
    rows = rows.where(has_payload("content", "reactions", "attachments"))
    rows = rows.withColumns({"sender": F.when(F.col("_sender") == "", "(unknown)").otherwise(F.col("_sender")), "ts": F.timestamp_millis("timestamp_ms"), "dt_iso": iso_seconds("timestamp_ms")})
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MESSAGES])


def threads_of(parsed: DataFrame) -> DataFrame:
    """Title and participants of each thread. The last title that isn't empty wins; then the folder's (file's) name, then participants."""
    given = F.when(F.col("standalone"), F.coalesce(F.nullif(F.col("data.title"), F.lit("")), F.col("data.threadName"))).otherwise(F.col("data.title"))
    rows = parsed.select("thread_key", "source_id", "source_seq", "standalone", "file_seq", clean_text(given).alias("t"), participants_of(F.col("data.participants")).alias("p"))
    folded = rows.groupBy("thread_key", "source_id", "source_seq", "standalone").agg(
        F.max_by("t", F.when(F.col("t") != "", F.col("file_seq"))).alias("t"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))).alias("participants"))
    last = F.regexp_extract("thread_key", r"([^/]*)\z", 1)
    stem = F.regexp_replace(last, r"\.json\z", "")
    own = F.when(F.col("standalone"), F.regexp_replace(stem, r"_[^_]*\z", "")).otherwise(last)
    title = F.coalesce(F.nullif(F.col("t"), F.lit("")), own)
    named = F.concat(F.array_join(F.slice("participants", 1, NAMED_IN_TITLE), ", "), F.when(F.size("participants") > NAMED_IN_TITLE, "…").otherwise(""))
    folded = folded.withColumn("title", F.when(is_blank(title) & (F.size("participants") > 0), named).otherwise(title))
    # folders first, then standalone files, each by path: the order in which ids are given out
    placed = with_place(folded, "source_seq", "standalone", "thread_key", name="thread_seq")
    return placed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in THREADS])


def read_archive(spark: SparkSession, roots, limit: int | None = None, after=None, before=None, keep_good_files: bool = False, before_inclusive_day: bool = False) -> Archive:
    """Threads and messages of one or more export folders.

    roots: paths, or (name, path) pairs. A thread with a file that can't be parsed is rejected whole, unless keep_good_files.
    limit: the first threads by path, before anything is parsed. Threads without messages (after the date filter) are dropped.
    """
    pairs = [(r, r) if isinstance(r, str) else r for r in ([roots] if isinstance(roots, str) else roots)]
    files = None
    for seq, (name, path) in enumerate(pairs):
        one = list_files(spark, path, name, seq)
        files = one if files is None else files.unionByName(one)
    found = discover(files)
    if len(pairs) > 1:  # sources may overlap
        found = found.withColumn("thread_key", F.concat_ws("|", "source_id", "thread_key"))
    if limit is not None:
        first = found.select("source_seq", "standalone", "thread_key").distinct().orderBy("source_seq", "standalone", "thread_key").limit(limit)
        found = found.join(F.broadcast(first.select("thread_key", "standalone")), ["thread_key", "standalone"], "left_semi")  # limit rows at most
    parsed = repair.load(found)
    bad = parsed.where("data is null").select(
        "path", "thread_key", F.lit("parse").alias("stage"), F.lit("not a JSON object, and repairs did not help").alias("error"))
    good = parsed.where("data is not null")
    if not keep_good_files:
        good = good.join(bad.select("thread_key").distinct(), "thread_key", "left_anti")
    fixes = good.where((F.size("fixes") > 0) | F.col("latin1")).select(
        "path", F.when(F.col("latin1"), F.concat("fixes", F.array(F.lit("read as Latin-1")))).otherwise(F.col("fixes")).alias("fixes"))
    messages = in_date_range(messages_of(good), after, before, before_inclusive_day)
    threads = threads_of(good).join(messages.select("thread_key").distinct(), "thread_key", "left_semi")
    return Archive(threads, messages, bad.select(*[safe_str(f.name).alias(f.name) for f in REJECTS]), fixes)


def from_table(df: DataFrame, thread, sender, content, timestamp_ms, order, source_id="table") -> DataFrame:
    """Any table of texts as messages: the columns or expressions given, with no attachments."""
    none = F.array().cast(MESSAGES["attachment_details"].dataType)
    rows = df.select(
        thread.cast("string").alias("thread_key"), F.lit(source_id).alias("source_id"), F.lit(0).alias("source_seq"), F.lit(0).cast("long").alias("file_seq"), order.cast("long").alias("msg_idx"),
        timestamp_ms.cast("long").alias("timestamp_ms"), sender.cast("string").alias("sender"), safe_str(content).alias("content"),
        F.lit("").alias("reactions"), F.lit("").alias("attachments"), none.alias("attachment_details"))
    return rows.withColumns({"ts": F.timestamp_millis("timestamp_ms"), "dt_iso": iso_seconds("timestamp_ms")}).select(*MESSAGES.names)
