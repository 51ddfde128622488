"""Queries of the archive operators over the driver's tables, with their DuckDB oracles.

conversations and events become messages by a thin adapter; everything else is the same code that serves export files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill.functions import text
from threadmill.functions.hashing import hamming64, hash_hex
from threadmill.operators import dedup, filters, ranks, stats
from threadmill.sources.export_reader import from_table

MINUTE_MS = 60_000
QUERIES, ORACLES = {}, {}

# what the adapters make of the tables, in DuckDB
CONV = "(SELECT CAST(conv_id AS VARCHAR) AS thread_key, role AS sender, coalesce(text, '') AS content, turn AS msg_idx FROM conversations)"
EV = ("(SELECT CAST(user_id AS VARCHAR) AS thread_key, event_type AS sender, coalesce(props, '') AS content, event_id AS msg_idx, epoch_us(ts) // 1000 AS timestamp_ms, "
      "strftime(ts, '%Y-%m-%dT%H:%M:%S') AS dt_iso, ts FROM events)")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conv(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return from_table(t, F.col("conv_id"), F.col("role"), F.col("text"), F.col("turn") * MINUTE_MS, F.col("turn"), "conversations")


def ev(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    return from_table(t, F.col("user_id"), F.col("event_type"), F.col("props"), F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id"), "events")


def query(oracle=None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query("SELECT role AS sender, count(*) AS n_messages FROM conversations GROUP BY ALL")
def messages_per_sender(spark, sf_dir):
    return stats.per(conv(spark, sf_dir), "sender", by_thread=False)


@query(f"SELECT thread_key, sender, count(*) AS n_messages FROM {CONV} GROUP BY ALL")
def per_thread_sender(spark, sf_dir):
    return stats.per(conv(spark, sf_dir), "sender")


@query(f"SELECT thread_key, count(*) AS n_messages, min(dt_iso)[:10] AS first_date, max(dt_iso)[:10] AS last_date FROM {EV} GROUP BY ALL")
def thread_summary(spark, sf_dir):
    return stats.thread_summary(ev(spark, sf_dir))


@query(f"SELECT thread_key, dt_iso[:7] AS month, count(*) AS n_messages FROM {EV} GROUP BY ALL")
def per_month(spark, sf_dir):
    return stats.per(ev(spark, sf_dir), "month")


@query(f"SELECT thread_key, dayname(ts) AS weekday, count(*) AS n_messages FROM {EV} GROUP BY ALL")
def per_weekday(spark, sf_dir):
    return stats.per(ev(spark, sf_dir), "weekday")


@query(f"SELECT thread_key, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n_messages FROM {EV} GROUP BY ALL")
def per_hour(spark, sf_dir):
    return stats.per(ev(spark, sf_dir), "hour")


@query(f"""SELECT thread_key, day, n_messages FROM (SELECT *, row_number() OVER (PARTITION BY thread_key ORDER BY n_messages DESC, day) AS r
    FROM (SELECT thread_key, dt_iso[:10] AS day, count(*) AS n_messages FROM {EV} GROUP BY ALL)) WHERE r = 1""")
def most_active_day(spark, sf_dir):
    return stats.most_active_day(ev(spark, sf_dir))


@query(f"""SELECT thread_key, sender, n_messages FROM (SELECT *, row_number() OVER (PARTITION BY thread_key ORDER BY n_messages DESC, f) AS r
    FROM (SELECT thread_key, sender, count(*) AS n_messages, min((timestamp_ms, msg_idx)) AS f FROM {EV} GROUP BY ALL)) WHERE r = 1""")
def top_sender(spark, sf_dir):
    return stats.top_sender(ev(spark, sf_dir))


@query(f"""SELECT thread_key, CAST(length(content) AS INTEGER) AS length, sender, strftime(make_timestamp(msg_idx * 60000000), '%Y-%m-%dT%H:%M:%S') AS dt_iso, content
    FROM (SELECT *, row_number() OVER (PARTITION BY thread_key ORDER BY length(content) DESC, msg_idx) AS r FROM {CONV} WHERE content <> '') WHERE r = 1""")
def longest_message(spark, sf_dir):
    return stats.longest_message(conv(spark, sf_dir))


@query(f"""SELECT thread_key, count(*) AS n_messages, CAST(sum(len(list_filter(regexp_split_to_array(content, '[\\s\\x0B\\x1C-\\x1F\\x85\\p{{Z}}]+'), lambda w: w <> ''))) AS BIGINT) AS n_words,
    CAST(sum(length(content)) AS BIGINT) AS n_chars, avg(length(content)) AS avg_length, CAST(1 AS INTEGER) AS days_span FROM {CONV} GROUP BY thread_key""")
def text_stats(spark, sf_dir):
    return stats.text_stats(conv(spark, sf_dir))


@query(f"""SELECT thread_key, count(*) AS n_responses, CAST(sum(gap) AS BIGINT) / count(*) / 60 AS avg_minutes FROM (
    SELECT thread_key, sender, lag(sender) OVER w AS was, timestamp_ms // 1000 - lag(timestamp_ms // 1000) OVER w AS gap FROM {EV} WINDOW w AS (PARTITION BY thread_key ORDER BY timestamp_ms, msg_idx))
    WHERE sender <> was AND gap > 0 AND gap < 86400 GROUP BY thread_key""")
def response_time(spark, sf_dir):
    return stats.response_time(ev(spark, sf_dir))


@query(f"""SELECT thread_key, dt_iso, sender, day FROM (SELECT *, dt_iso[:10] AS day, lag(dt_iso[:10]) OVER (PARTITION BY thread_key ORDER BY timestamp_ms, msg_idx) AS was FROM {EV})
    WHERE was IS NULL OR was <> day""")
def date_divider(spark, sf_dir):
    return stats.date_dividers(ev(spark, sf_dir)).select("thread_key", "dt_iso", "sender", "day")


@query(f"SELECT thread_key, msg_idx, dt_iso FROM (SELECT thread_key, CAST(msg_idx AS INTEGER) AS msg_idx, dt_iso, epoch_ms(timestamp_ms) AS t FROM {EV}) WHERE t BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'")
def date_range(spark, sf_dir):
    return filters.in_date_range(ev(spark, sf_dir), "2024-01-10", "2024-01-20").select("thread_key", F.col("msg_idx").cast("int").alias("msg_idx"), "dt_iso")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the')")
def search_ci(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return filters.search(t, "THE").select("doc_id")


@query(f"""WITH found AS (SELECT * FROM {CONV} WHERE contains(lower(content), 'an'))
    SELECT thread_key, n AS n_matches, greatest(n - 3, 0) AS n_more, CAST(r AS INTEGER) AS rank, strftime(make_timestamp(msg_idx * 60000000), '%Y-%m-%dT%H:%M:%S') AS dt_iso, sender,
    replace(content[:100] || CASE WHEN length(content) > 100 THEN '...' ELSE '' END, chr(10), ' ') AS preview
    FROM (SELECT *, row_number() OVER (PARTITION BY thread_key ORDER BY msg_idx) AS r, count(*) OVER (PARTITION BY thread_key) AS n FROM found) WHERE r <= 3""")
def search_report_top3(spark, sf_dir):
    return filters.search_report(conv(spark, sf_dir), "an")


@query("SELECT doc_id, replace(coalesce(text, '')[:100] || CASE WHEN length(text) > 100 THEN '...' ELSE '' END, chr(10), ' ') AS preview FROM documents")
def search_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview("text").alias("preview"))


@query(f"""SELECT CASE WHEN g = 3 THEN 'sender' WHEN g = 5 THEN 'month' WHEN g = 6 THEN 'thread' ELSE 'total' END AS kind, key, n_messages, n_words FROM (
    SELECT grouping(sender, month, thread_key) AS g, coalesce(sender, month, thread_key) AS key, count(*) AS n_messages, CAST(coalesce(sum(w), 0) AS BIGINT) AS n_words
    FROM (SELECT sender, thread_key, dt_iso[:7] AS month, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) AS w FROM {EV})
    GROUP BY GROUPING SETS ((), (sender), (month), (thread_key)))""")
def dashboard_grouping_sets(spark, sf_dir):
    return stats.dashboard(ev(spark, sf_dir))


@query(f"""SELECT sender, n_messages, 100 * n_messages / (SELECT count(*) FROM events) AS percent FROM (
    SELECT sender, count(*) AS n_messages, min((thread_key, timestamp_ms, msg_idx)) AS f FROM {EV} GROUP BY sender ORDER BY n_messages DESC, f LIMIT 20)""")
def top20_senders(spark, sf_dir):
    return stats.top_senders(ev(spark, sf_dir))


@query(f"SELECT dt_iso[:7] AS month, count(*) AS n_messages FROM {EV} GROUP BY month ORDER BY month DESC LIMIT 24")
def last24_months(spark, sf_dir):
    return stats.last_months(ev(spark, sf_dir))


@query("""SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, text[:50] ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def dedup_first_wins(spark, sf_dir):
    t = table(spark, sf_dir, "documents").withColumn("p", F.substring("text", 1, dedup.MERGE_PREFIX))
    return dedup.first_of(t.select("doc_id", "lang", "source", "p"), ["lang", "source", "p"], ["doc_id"]).drop("p")


def _threads(spark, sf_dir):
    """Conversations as threads whose participants are their roles."""
    rows = conv(spark, sf_dir).groupBy("thread_key", "source_id", "source_seq").agg(F.array_sort(F.collect_set("sender")).alias("participants"))
    return rows.select("thread_key", "source_id", "source_seq", F.col("thread_key").cast("int").alias("thread_seq"), F.concat(F.lit("Conversation "), F.col("thread_key")).alias("title"), "participants")


@query(f"""SELECT s AS participants, count(*) AS n_threads, list_sort(list(thread_key)) AS thread_keys FROM (
    SELECT thread_key, array_to_string(list_sort(list(DISTINCT upper(sender[:1]) || lower(sender[2:]))), ', ') AS s FROM {CONV} GROUP BY thread_key) GROUP BY s HAVING count(*) > 1""")
def duplicate_groups(spark, sf_dir):
    return dedup.duplicate_groups(_threads(spark, sf_dir))


@query("""WITH g AS (SELECT conv_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS s FROM conversations GROUP BY conv_id),
    m AS (SELECT c.*, min(conv_id) OVER (PARTITION BY s) AS t FROM conversations c JOIN g USING (conv_id))
    SELECT CAST(t AS VARCHAR) AS thread_key, count(*) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (
    SELECT *, row_number() OVER (PARTITION BY t, turn, role, coalesce(text, '')[:50] ORDER BY conv_id) AS r FROM m) WHERE r = 1 GROUP BY t""")
def merge_union(spark, sf_dir):
    _, merged = dedup.merge(_threads(spark, sf_dir), conv(spark, sf_dir))
    return merged.groupBy("thread_key").agg(F.count("*").alias("n_messages"), F.sum(F.length("content").cast("long")).alias("n_chars"))


@query("SELECT 'k' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS VARCHAR) AS type, count(*) AS n_attachments FROM events GROUP BY ALL")
def attachments_by_type(spark, sf_dir):
    kind = F.concat(F.lit("k"), (F.get_json_object("content", "$.k").cast("int") % 7).cast("string"))
    details = F.array(F.struct(kind.alias("type")))
    return stats.attachment_counts(ev(spark, sf_dir).withColumn("attachment_details", details), by_thread=False)


@query("SELECT doc_id, (row_number() OVER (ORDER BY source, doc_id) - 1) // 64 + 1 AS batch FROM documents")
def batch_pack(spark, sf_dir):
    return ranks.batches(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", size=64).select("doc_id", "batch")


@query("""SELECT doc_id, i AS index, (i - 1) * 950 AS top, least((i - 1) * 950 + 1000, n_chars) AS bottom FROM (
    SELECT doc_id, n_chars, unnest(range(1, CASE WHEN n_chars <= 1000 THEN 1 ELSE 1 + CAST(ceil((n_chars - 1000) / 950) AS BIGINT) END + 1)) AS i FROM documents)""")
def slice_windows(spark, sf_dir):
    return ranks.windows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 1000, 50).select("doc_id", "index", "top", "bottom")


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[\\\\/:*?"<>|]', '-', 'g'), '[\\t\\r\\f\\v ]+', '_', 'g'), '_+', '_', 'g')[:140] AS slug FROM pages""")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.slugify("url").alias("slug"))


@query("SELECT page_id, split_part(regexp_extract(url, '[^/]*$'), '?', 1) AS filename FROM pages")
def uri_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.uri_filename("url").alias("filename"))


def unique_thread_id(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    base = text.slugify(F.concat("p_name", F.when(F.col("p_size") % 5 == 0, F.lit(" 2")).otherwise(F.lit(""))))
    return dedup.unique_ids(parts, "p_partkey", base, "p_partkey")


QUERIES["unique_thread_id"] = unique_thread_id
# the ids of a root are handed out one after the other: each step of the recursion takes the next row of every root
ORACLES["unique_thread_id"] = r"""WITH RECURSIVE b AS (SELECT p_partkey, substring(regexp_replace(regexp_replace(lower(p_name || CASE WHEN p_size % 5 = 0 THEN ' 2' ELSE '' END), ' +', '_', 'g'), '_+', '_', 'g'), 1, 140) AS base FROM part),
    p AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY p_partkey) AS n FROM (SELECT *, regexp_replace(base, '(_[0-9]+)+$', '') AS root FROM b)),
    r AS (SELECT p_partkey, base, root, n, base AS thread_id, [base] AS used FROM p WHERE n = 1
          UNION ALL SELECT p_partkey, base, root, n, id, list_append(used, id) FROM (SELECT p.p_partkey, p.base, p.root, p.n, r.used,
              list_filter(list_prepend(p.base, list_transform(range(2, p.n + 2), lambda k: p.base || '_' || CAST(k AS VARCHAR))), lambda x: NOT list_contains(r.used, x))[1] AS id
              FROM r JOIN p ON p.root = r.root AND p.n = r.n + 1))
    SELECT p_partkey, base, thread_id FROM r"""


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;') AS escaped FROM documents WHERE text IS NOT NULL")
def escape_html(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.escape_html("text").alias("escaped"))


# Texts are dirtied first, as the tables are clean: blanks before each "e", a tab and CRs before line ends, runs of line feeds.
@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    chr(10) || replace(replace(text, 'e', ' ' || chr(9) || ' e'), chr(10), chr(9) || ' ' || chr(13) || chr(10) || chr(13) || chr(10) || chr(10) || chr(10) || chr(1)) || ' ' || chr(10),
    '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') , '[\\t ]+', ' ', 'g'), ' +\\n', chr(10), 'g'), ' +$', ''), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\\n+', ''), '\\n+$', '') AS cleaned
    FROM (SELECT doc_id, replace(text, chr(13), '') AS text FROM documents WHERE text IS NOT NULL)""".replace("chr(13) || ", ""))
def clean_whitespace(spark, sf_dir):
    t = table(spark, sf_dir, "documents").where("text is not null")
    dirty = F.concat(F.lit("\n"), F.replace(F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit("e"), F.lit(" \t e")), F.lit("\n"), F.lit("\t \r\n\r\n\n\n\x01")), F.lit(" \r"))
    return t.select("doc_id", text.clean_text(dirty, entities=False).alias("cleaned"))


@query("SELECT doc_id, text AS repaired FROM documents WHERE regexp_matches(text, '[áàâãäçèéêëíñóôöúüß]') AND NOT regexp_matches(text, '[^\\x{00}-\\x{FF}]')")
def mojibake_roundtrip(spark, sf_dir):
    t = table(spark, sf_dir, "documents").where(F.col("text").rlike("[áàâãäçèéêëíñóôöúüß]") & ~F.col("text").rlike(text.BEYOND_LATIN1))
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return t.select("doc_id", text.fix_mojibake(broken).alias("repaired"))


def mojibake_all(spark, sf_dir):
    """Every document's text as it is and double-encoded, both repaired; null texts stay null."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, sf_dir, "documents").select("doc_id", text.fix_mojibake("text").alias("kept"), text.fix_mojibake(broken).alias("repaired"))


QUERIES["mojibake_all"] = mojibake_all  # all documents, where mojibake_roundtrip has those that its SQL selects: compared with a loop in the tests


@query("""WITH b AS (SELECT vec_id, list_sum(list_transform(range(0, 62), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS BIGINT) << i ELSE 0 END))::BIGINT AS h FROM embeddings)
    SELECT a.vec_id, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance, lower(lpad(printf('%X', a.h), 16, '0')) AS hash FROM b AS a JOIN b ON b.vec_id = a.vec_id + 1""")
def hamming_pairs(spark, sf_dir):
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(61)), F.lit(0).cast("long"), lambda s, i: s + F.when(F.get("embedding", i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(0))
    t = table(spark, sf_dir, "embeddings").select("vec_id", bits.alias("h"))
    after = t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("h2"))
    return t.join(after, "vec_id").select("vec_id", hamming64("h", "h2").alias("distance"), hash_hex("h").alias("hash"))


@query("""SELECT source AS source_id, count(*) AS n_threads, CAST(sum(n) AS BIGINT) AS n_messages FROM (
    SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY ROLLUP (source)""")
def unified_index(spark, sf_dir):
    return stats.source_totals(table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("lang").alias("thread_key")))
