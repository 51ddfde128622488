"""Statistics of threads and of whole archives.

Each is a grouped aggregation, so Spark combines on the map side; where messages are needed in order, threads are dealt by
their days. A thread is never gathered into one row: counts by sender, month and so on are rows, and become maps at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions.text import word_count
from threadmill.schema import ORDER

# The longest gap that counts as a response, and the sizes of the dashboard's tables.
DAY_SECONDS = 86_400
TOP_SENDERS, LAST_MONTHS, TITLE_SHOWN = 20, 24, 30

BUCKETS = {
    "sender": lambda: F.col("sender"), "month": lambda: F.substring("dt_iso", 1, 7), "weekday": lambda: F.date_format("ts", "EEEE"),
    "hour": lambda: F.hour("ts"), "day": lambda: F.substring("dt_iso", 1, 10)}


def per(messages: DataFrame, *buckets: str, by_thread: bool = True) -> DataFrame:
    """Counts by thread and the buckets named: sender, month, weekday, hour, day."""
    keys = (["thread_key"] if by_thread else []) + [BUCKETS[b]().alias(b) for b in buckets]
    return messages.groupBy(*keys).agg(F.count("*").alias("n_messages"))


def top_of(counts: DataFrame, ties, keys=("thread_key",)) -> DataFrame:
    """Of each group of counts the one with most messages; ties go to the least in the order given."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n_messages"), *ties))
    return counts.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def most_active_day(messages: DataFrame) -> DataFrame:
    """Each thread's day with most messages, the earliest of equals."""
    return top_of(per(messages, "day"), ["day"])


def top_sender(messages: DataFrame) -> DataFrame:
    """Each thread's sender with most messages, of equals the one seen first."""
    seen = messages.groupBy("thread_key", "sender").agg(F.count("*").alias("n_messages"), F.min(F.struct(*ORDER)).alias("_first"))
    return top_of(seen, ["_first"]).drop("_first")


def thread_summary(messages: DataFrame) -> DataFrame:
    """Count, first and last day of each thread."""
    return messages.groupBy("thread_key").agg(F.count("*").alias("n_messages"), F.min(BUCKETS["day"]()).alias("first_date"), F.max(BUCKETS["day"]()).alias("last_date"))


def text_stats(messages: DataFrame) -> DataFrame:
    """Words, characters and mean length of each thread, and how many calendar days it spans."""
    return messages.groupBy("thread_key").agg(
        F.count("*").alias("n_messages"), F.sum(word_count("content").cast("long")).alias("n_words"), F.sum(F.length("content").cast("long")).alias("n_chars"),
        F.avg(F.length("content")).alias("avg_length"), (F.datediff(F.max(F.to_date("ts")), F.min(F.to_date("ts"))) + 1).alias("days_span"))


def longest_message(messages: DataFrame) -> DataFrame:
    """The longest message of each thread, the first of equals; threads of empty messages have none."""
    key = F.struct(F.length("content").alias("length"), *[(-F.col(c).cast("long")).alias(c) for c in ORDER])
    rows = messages.where(F.length("content") > 0).groupBy("thread_key").agg(F.max(F.struct(key.alias("k"), "sender", "content", "dt_iso")).alias("m"))
    return rows.select("thread_key", F.col("m.k.length").alias("length"), F.col("m.sender").alias("sender"), F.col("m.dt_iso").alias("dt_iso"), F.col("m.content").alias("content"))


def response_gaps(messages: DataFrame) -> DataFrame:
    """Seconds from each message to the one before it in the thread, where the sender changed and 0 < gap < a day.

    A thread is dealt by its days (of epoch seconds), so a long one is no single task's work: the message before is of the same
    day or, as the gap is less than a day, the last one of the day before.
    """
    rows = messages.select("thread_key", *ORDER, "sender", F.floor(F.col("timestamp_ms") / 1000).alias("second")).withColumn("day", F.floor(F.col("second") / DAY_SECONDS))
    w = Window.partitionBy("thread_key", "day").orderBy(*ORDER)
    within = rows.withColumns({"_was": F.lag("sender").over(w), "_then": F.lag("second").over(w), "_first": F.row_number().over(w) == 1})
    last = rows.groupBy("thread_key", "day").agg(F.max(F.struct(*ORDER, "sender", "second")).alias("x"))
    last = last.select("thread_key", (F.col("day") + 1).alias("day"), F.col("x.sender").alias("_was"), F.col("x.second").alias("_then"))
    firsts = within.where("_first").drop("_was", "_then").join(last, ["thread_key", "day"])
    columns = ["thread_key", "sender", "_was", (F.col("second") - F.col("_then")).alias("gap")]
    both = within.where("not _first").select(*columns).unionByName(firsts.select(*columns))
    return both.where((F.col("sender") != F.col("_was")) & (F.col("gap") > 0) & (F.col("gap") < DAY_SECONDS)).select("thread_key", "sender", "gap")


def response_time(messages: DataFrame) -> DataFrame:
    """Responses and their mean minutes by thread."""
    return response_gaps(messages).groupBy("thread_key").agg(F.count("*").alias("n_responses"), (F.sum("gap") / F.count("*") / 60).alias("avg_minutes"))


def attachment_counts(messages: DataFrame, by_thread: bool = True) -> DataFrame:
    keys = ["thread_key"] if by_thread else []
    return messages.select("thread_key", F.explode("attachment_details.type").alias("type")).groupBy(*keys, "type").agg(F.count("*").alias("n_attachments"))


def date_dividers(messages: DataFrame) -> DataFrame:
    """The messages that start a new day in their thread: the first of each day, as a thread is in order of time."""
    w = Window.partitionBy("thread_key", "day").orderBy(*ORDER)
    return messages.withColumn("day", BUCKETS["day"]()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _map(counts: DataFrame, key: str, name: str, value: str = "n_messages") -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("key"), F.col(value).alias("value"))))
    return counts.groupBy("thread_key").agg(F.map_from_entries(pairs).alias(name))


def thread_statistics(messages: DataFrame, threads: DataFrame | None = None) -> DataFrame:
    """A row for each thread with all of its statistics; counts by bucket are maps. The messages are read once: they are persisted."""
    messages = messages.persist()
    out = text_stats(messages).join(thread_summary(messages).drop("n_messages"), "thread_key")
    day = most_active_day(messages).select("thread_key", F.struct(F.col("day").alias("date"), F.col("n_messages").alias("count")).alias("most_active_day"))
    longest = longest_message(messages).select("thread_key", F.struct("length", "sender", "dt_iso", "content").alias("longest_message"))
    parts = [day, longest, response_time(messages)]
    parts += [_map(per(messages, b), b, f"messages_per_{b}") for b in ("sender", "month", "weekday", "hour")]
    parts.append(_map(attachment_counts(messages), "type", "attachments_by_type", "n_attachments"))
    for part in parts:
        out = out.join(part, "thread_key", "left")
    return out if threads is None else threads.join(out, "thread_key")


def dashboard(messages: DataFrame) -> DataFrame:
    """Totals, and counts by sender, by month and by thread, in one pass: kind, key, n_messages, n_words."""
    rows = messages.select("thread_key", "sender", BUCKETS["month"]().alias("month"), word_count("content").cast("long").alias("w"))
    sets = rows.groupingSets([[], [F.col("sender")], [F.col("month")], [F.col("thread_key")]], F.col("sender"), F.col("month"), F.col("thread_key"))
    # grouping_id has a bit for each key, in order, that isn't grouped by
    kind = F.when(F.grouping_id() == 3, "sender").when(F.grouping_id() == 5, "month").when(F.grouping_id() == 6, "thread").otherwise("total")
    counted = sets.agg(kind.alias("kind"), F.count("*").alias("n_messages"), F.coalesce(F.sum("w"), F.lit(0)).alias("n_words"))
    return counted.select("kind", F.coalesce("sender", "month", "thread_key").alias("key"), "n_messages", "n_words")


def top_senders(messages: DataFrame, n: int = TOP_SENDERS) -> DataFrame:
    """The senders with most messages in all threads, of equals the one seen first, with their share."""
    order = F.min(F.struct("source_seq", "thread_key", *ORDER))
    counts = messages.groupBy("sender").agg(F.count("*").alias("n_messages"), order.alias("_first"))
    total = messages.agg(F.count("*").alias("_total"))
    return (counts.orderBy(F.desc("n_messages"), "_first").limit(n).crossJoin(total)  # of one row
            .select("sender", "n_messages", (100 * F.col("n_messages") / F.col("_total")).alias("percent")))


def last_months(messages: DataFrame, n: int = LAST_MONTHS) -> DataFrame:
    """The last months that have messages."""
    return per(messages, "month", by_thread=False).orderBy(F.desc("month")).limit(n)


def index(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """A row for each thread: count, dates, top sender, in the order of an index (most messages first, then as read)."""
    top = top_sender(messages).select("thread_key", F.col("sender").alias("top_sender"), F.col("n_messages").alias("top_count"))
    rows = threads.join(thread_summary(messages), "thread_key").join(top, "thread_key", "left")
    return rows.orderBy(F.desc("n_messages"), "thread_seq")


def source_totals(messages: DataFrame) -> DataFrame:
    """Threads and messages by source, and over all (source null)."""
    rows = messages.groupBy("source_id", "thread_key").agg(F.count("*").alias("n"))
    return rows.rollup("source_id").agg(F.count("*").alias("n_threads"), F.sum("n").alias("n_messages"))
