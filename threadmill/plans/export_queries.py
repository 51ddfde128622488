"""Queries of the export reader, the phrases, the sinks and the image kernels over the driver's tables, with their oracles.

Conversations are written out as the texts of export files, damaged where that is the point, and read by the same code that
reads real exports; oracles say what must come back in terms of the table. Embeddings become small gray pictures.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.functions import attachments, hashing, text
from threadmill.operators import dedup, filters, stats
from threadmill.plans.archive_queries import CONV, EV, MINUTE_MS, conv, ev, table
from threadmill.schema import RAW_MESSAGE
from threadmill.session import checkpoint_dir
from threadmill.sinks import threads as sinks
from threadmill.sources import repair
from threadmill.sources.export_reader import discover, messages_of, threads_of

QUERIES, ORACLES = {}, {}
#: Turns of a conversation that one export file has.
PART = 4


def query(oracle=None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def export_files(rows, damage=lambda raw, conv: raw):
    """Conversations as listed export files ``c/<conv_id>/message_<n>.json`` of PART turns; those of odd ids use the other names of the fields."""
    rows = rows.withColumn("part", F.floor(F.col("turn") / PART) + 1)
    odd, ms = F.col("conv_id") % 2 == 1, F.col("turn") * MINUTE_MS
    usual = F.to_json(F.struct(F.col("role").alias("sender_name"), ms.alias("timestamp_ms"), F.col("text").alias("content")))
    other = F.to_json(F.struct(F.col("role").alias("senderName"), ms.cast("string").alias("timestamp"), F.col("text")))
    rows = rows.withColumn("json", F.when(odd, other).otherwise(usual))
    # a file is a row: its messages are gathered, PART at most
    files = rows.groupBy("conv_id", "part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "json"))), lambda x: x["json"]).alias("messages"), F.array_sort(F.collect_set("role")).alias("roles"))
    people = F.when(F.col("conv_id") % 2 == 1, F.to_json("roles")).otherwise(F.to_json(F.transform("roles", lambda r: F.struct(r.alias("name")))))
    title = F.when(F.col("conv_id") % 3 == 0, F.lit("")).otherwise(F.format_string("Talk %d of %d", "part", "conv_id"))
    raw = F.concat(F.lit('{"title": "'), title, F.lit('", "participants": '), people, F.lit(', "messages": ['), F.array_join("messages", ",\n"), F.lit("]}"))
    name = F.format_string("message_%d.json", "part")
    folder = F.concat(F.lit("c/"), F.col("conv_id").cast("string"))
    return files.select(
        F.concat_ws("/", folder, name).alias("path"), folder.alias("dir"), name.alias("name"), damage(raw, F.col("conv_id")).alias("raw"), F.lit(False).alias("latin1"),
        F.octet_length(raw).cast("long").alias("size"), F.lit("c").alias("source_id"), F.lit(0).alias("source_seq"), F.lit(False).alias("top"))


@query(f"""SELECT 'c/' || CAST(conv_id AS VARCHAR) AS thread_key, turn // {PART} AS file_seq, turn % {PART} AS msg_idx, turn * {MINUTE_MS} AS timestamp_ms,
    strftime(make_timestamp(turn * 60000000), '%Y-%m-%dT%H:%M:%S') AS dt_iso, role AS sender, text AS content FROM conversations""")
def export_messages(spark, sf_dir):
    found = discover(export_files(table(spark, sf_dir, "conversations")))
    return messages_of(repair.load(found)).select("thread_key", "file_seq", "msg_idx", "timestamp_ms", "dt_iso", "sender", "content")


@query(f"""SELECT 'c/' || CAST(conv_id AS VARCHAR) AS thread_key, CASE WHEN conv_id % 3 = 0 THEN CAST(conv_id AS VARCHAR) ELSE format('Talk {{}} of {{}}', max(turn) // {PART} + 1, conv_id) END AS title,
    list_sort(list(DISTINCT role)) AS participants, CAST(row_number() OVER (ORDER BY 'c/' || CAST(conv_id AS VARCHAR)) - 1 AS INTEGER) AS thread_seq FROM conversations GROUP BY conv_id""")
def export_threads(spark, sf_dir):
    found = discover(export_files(table(spark, sf_dir, "conversations")))
    return threads_of(repair.load(found)).select("thread_key", "title", "participants", "thread_seq")


def _damaged(raw, conv):
    """Of each five conversations: a comma after the last message, a message whose sender lacks the comma before it, a message
    that breaks off after its time, a file that breaks off, and one as it was."""
    missing = F.replace(raw, F.lit('"messages": ['), F.lit('"messages": [{"content": "first", "timestamp_ms": 7\n "sender_name": "S"},'))
    broken = F.replace(raw, F.lit('"messages": ['), F.lit('"messages": [{ "sender_name": "S", "timestamp_ms": 8 "sender_name": "T", "timestamp_ms": 9, "content": "kept, ] too"},'))
    kind = conv % 5
    return (F.when(kind == 0, F.concat(F.substring(raw, F.lit(1), F.length(raw) - 2), F.lit(",\n ]}"))).when(kind == 1, missing).when(kind == 2, broken)
            .when(kind == 3, F.substring(raw, F.lit(1), F.length(raw) - 2)).otherwise(raw))


@query(f"""WITH f AS (SELECT conv_id, turn // {PART} AS part, count(*) AS n FROM conversations GROUP BY ALL)
    SELECT 'c/' || CAST(conv_id AS VARCHAR) || '/message_' || CAST(part + 1 AS VARCHAR) || '.json' AS path, conv_id % 5 = 3 AS rejected,
    CASE conv_id % 5 WHEN 0 THEN 'removed trailing commas' WHEN 1 THEN 'added a missing comma before sender_name' WHEN 2 THEN 'closed a truncated message' ELSE '' END AS fixes,
    CASE conv_id % 5 WHEN 1 THEN n + 1 WHEN 2 THEN n + 1 WHEN 3 THEN 0 ELSE n END AS n_messages FROM f""")
def export_repaired(spark, sf_dir):
    found = repair.load(discover(export_files(table(spark, sf_dir, "conversations"), _damaged)))
    counts = messages_of(found.where("data is not null")).groupBy("thread_key", "file_seq").agg(F.count("*").alias("n"))
    rows = found.select("path", "thread_key", "file_seq", F.col("data").isNull().alias("rejected"), F.array_join("fixes", "; ").alias("fixes"))
    return rows.join(counts, ["thread_key", "file_seq"], "left").select("path", "rejected", "fixes", F.coalesce("n", F.lit(0)).alias("n_messages"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE role || ' by a' || CAST(turn AS VARCHAR) || CASE WHEN turn % 3 = 1 THEN '' ELSE '; x' END END AS reactions FROM conversations""")
def reaction_phrases(spark, sf_dir):
    one = lambda rx, by: F.struct(rx.cast("string").alias("reaction"), by.cast("string").alias("actor"))
    first, bare, empty = one(F.col("role"), F.concat(F.lit("a"), F.col("turn").cast("string"))), one(F.lit("x"), F.lit(None)), one(F.lit(" "), F.lit("nobody"))
    given = F.when(F.col("turn") % 3 == 1, F.array(first, empty)).when(F.col("turn") % 3 == 2, F.array(empty, first, bare))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", attachments.reaction_summary(given).alias("reactions"))


def _with_attachments(spark, sf_dir):
    """Pages as raw messages: media of one of five kinds (the second without a name), a sticker or not, a share with a link or a text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    media = F.array(*[F.struct(u.cast("string").alias("uri"), F.struct(F.concat(F.col("url"), F.lit(".jpg")).alias("uri")).alias("thumbnail")) for u in (F.col("url"), F.lit(""))])
    fields = []
    for f in RAW_MESSAGE:
        if f.name in (kinds := [m[0] for m in attachments.MEDIA_KINDS]):
            value = F.when(F.col("page_id") % 6 == kinds.index(f.name), F.slice(media, 1, (F.col("page_id") % 2 + 1).cast("int")))
        elif f.name == "sticker":
            value = F.when(F.col("page_id") % 4 == 0, F.to_json(F.struct(F.col("url").alias("uri")))).when(F.col("page_id") % 4 == 1, F.lit("false"))
        elif f.name == "share":
            value = F.when(F.col("page_id") % 5 == 0, F.to_json(F.struct(F.col("url").alias("link"), F.lit("a &amp; b").alias("share_text")))).when(F.col("page_id") % 5 == 1, F.lit('{"share_text": "t"}')).when(F.col("page_id") % 5 == 2, F.lit("odd"))
        else:
            value = F.lit(None)
        fields.append(value.cast(f.dataType).alias(f.name))
    return pages.select("page_id", "url", F.struct(*fields).alias("m"))


_FILE = "split_part(regexp_extract(url, '[^/]*$'), '?', 1)"


@query(f"""SELECT page_id, concat_ws('; ',
    CASE WHEN page_id % 6 < 5 THEN CAST(page_id % 2 + 1 AS VARCHAR) || ' ' || CASE WHEN {_FILE} <> ''
        THEN ['photo(s)', 'video(s)', 'audio', 'file(s)', 'gif(s)'][page_id % 6 + 1] || ': ' || {_FILE} ELSE ['photo(s)', 'video(s)', 'audio file(s)', 'file(s)', 'gif(s)'][page_id % 6 + 1] END END,
    CASE WHEN page_id % 4 = 0 THEN 'sticker' END, CASE WHEN page_id % 5 = 0 THEN 'share: ' || url WHEN page_id % 5 = 1 THEN 'share' END) AS attachments FROM pages""")
def attachment_phrases(spark, sf_dir):
    return _with_attachments(spark, sf_dir).select("page_id", attachments.attachment_summary("m").alias("attachments"))


@query(f"""WITH p AS (SELECT page_id, url, {_FILE} AS f, ['photo', 'video', 'audio', 'file', 'gif'][page_id % 6 + 1] AS kind FROM pages)
    SELECT page_id, kind AS type, CASE WHEN i = 1 THEN url ELSE '' END AS uri, CASE WHEN kind <> 'gif' THEN CASE WHEN i = 1 THEN f ELSE '' END END AS filename,
        CASE WHEN kind = 'video' THEN url || '.jpg' END AS thumbnail, NULL AS link, NULL AS text FROM (SELECT *, unnest(range(1, page_id % 2 + 2)) AS i FROM p WHERE page_id % 6 < 5)
    UNION ALL SELECT page_id, 'sticker', url, NULL, NULL, NULL, NULL FROM p WHERE page_id % 4 = 0
    UNION ALL SELECT page_id, 'share', NULL, NULL, NULL, CASE WHEN page_id % 5 = 0 THEN url END, CASE WHEN page_id % 5 = 0 THEN 'a &amp; b' ELSE 't' END FROM p WHERE page_id % 5 < 2""")
def attachment_explode(spark, sf_dir):
    rows = _with_attachments(spark, sf_dir).select("page_id", F.explode(attachments.attachment_details("m")).alias("d"))
    return rows.select("page_id", "d.*")


@query("SELECT page_id, html AS text FROM pages")
def html_unescape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.unescape_html(text.escape_html("html")).alias("text"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing.content_hash("text").alias("hash"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[:1]) || lower(w[2:])), ' ') AS title FROM part")
def title_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", dedup._title(F.lower("p_name")).alias("title"))


@query(f"""SELECT DISTINCT thread_key FROM (SELECT thread_key, epoch_ms(timestamp_ms) AS t FROM {EV}) WHERE t BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-10 06:00:00'""")
def empty_threads_dropped(spark, sf_dir):
    messages = ev(spark, sf_dir)
    # by ts: dt_iso is floored to seconds
    kept = filters.in_date_range(messages, "2024-01-10", "2024-01-11").where(F.col("ts") <= F.lit("2024-01-10 06:00:00").cast("timestamp"))
    threads, filled = messages.select("thread_key").distinct().alias("t"), kept.select("thread_key").distinct().alias("k")
    return threads.join(filled, F.expr("t.thread_key <=> k.thread_key"), "left_semi")  # messages without a thread are one, as in SQL


@query(f"""WITH s AS (SELECT thread_key, sender, count(*) AS n, min((timestamp_ms, msg_idx)) AS f FROM {EV} GROUP BY ALL),
    top AS (SELECT thread_key, sender AS top_sender, n AS top_count FROM (SELECT *, row_number() OVER (PARTITION BY thread_key ORDER BY n DESC, f) AS r FROM s) WHERE r = 1),
    t AS (SELECT thread_key, count(*) AS n_messages, min(dt_iso)[:10] AS first_date, max(dt_iso)[:10] AS last_date FROM {EV} GROUP BY ALL)
    SELECT thread_key, n_messages, first_date, last_date, top_sender, top_count, row_number() OVER (ORDER BY n_messages DESC, CAST(thread_key AS BIGINT)) AS place FROM t JOIN top USING (thread_key)""")
def index_rows(spark, sf_dir):
    from threadmill.operators.ranks import with_place

    messages = ev(spark, sf_dir)
    threads = messages.select("thread_key", F.col("thread_key").cast("int").alias("thread_seq")).distinct()
    rows = with_place(stats.index(messages, threads), F.desc("n_messages"), "thread_seq")
    return rows.select("thread_key", "n_messages", "first_date", "last_date", "top_sender", "top_count", (F.col("place") + 1).alias("place"))


def _written(spark, sf_dir, fmt):
    """The files that a sink makes of conversations, read back: name and content."""
    out = f"{checkpoint_dir(spark)}/sink-{uuid.uuid4().hex}"
    messages = conv(spark, sf_dir)
    threads = messages.groupBy("thread_key").agg(F.array_sort(F.collect_set("sender")).alias("participants"))
    threads = threads.select("thread_key", F.concat(F.lit("c"), "thread_key").alias("thread_id"), F.concat(F.lit("Talk "), "thread_key").alias("title"), "participants")
    sinks.write_threads(messages, threads, out, fmt).write.format("noop").mode("overwrite").save()
    files = spark.read.format("binaryFile").load(out)
    return files.select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("hash"))


_WHOLE = "SELECT file, octet_length(encode(body)) AS n_bytes, sha256(body) AS hash FROM ("
_ISO = "strftime(make_timestamp(msg_idx * 60000000), '%Y-%m-%dT%H:%M:%S')"


@query(_WHOLE + f"""SELECT 'c' || thread_key || '.md' AS file, '# Talk ' || thread_key || chr(10) || chr(10) || '**Thread ID:** `c' || thread_key || '`' || chr(10) || '**Participants:** '
    || array_to_string(list_sort(list(DISTINCT sender)), ', ') || chr(10) || '**Messages:** ' || CAST(count(*) AS VARCHAR) || chr(10) || chr(10) || '---' || chr(10)
    || string_agg(chr(10) || '## ' || {_ISO} || ' — ' || sender || chr(10) || chr(10) || CASE WHEN content = '' THEN '*(no text)*' ELSE content END || chr(10) || chr(10) || '---' || chr(10), '' ORDER BY msg_idx) AS body
    FROM {CONV} GROUP BY thread_key)""")
def markdown_files(spark, sf_dir):
    return _written(spark, sf_dir, "md")


_QUOTED = "CASE WHEN regexp_matches(content, '[,\"\\r\\n]') THEN '\"' || replace(content, '\"', '\"\"') || '\"' ELSE content END"


@query(_WHOLE + f"""SELECT 'c' || thread_key || '.csv' AS file, 'dt_iso,sender,content,reactions,attachments,timestamp_ms' || chr(13) || chr(10)
    || string_agg({_ISO} || ',' || sender || ',' || {_QUOTED} || ',,,' || CAST(msg_idx * {MINUTE_MS} AS VARCHAR) || chr(13) || chr(10), '' ORDER BY msg_idx) AS body FROM {CONV} GROUP BY thread_key)""")
def csv_files(spark, sf_dir):
    return _written(spark, sf_dir, "csv")


# Pictures: 8 rows of 8 gray pixels, from the embedding's 64 numbers; the ninth column of a hash's picture is gray.
_PIXELS = "(SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor((least(greatest(CAST(e AS DOUBLE), -0.5), 0.5) + 0.5) * 255) AS INTEGER)) AS g FROM embeddings)"
_HASHES = (f"(SELECT vec_id, g, list_reduce(list_transform(range(0, 64), lambda k: CASE WHEN g[k + 1] > (CASE WHEN k % 8 = 7 THEN 128 ELSE g[k + 2] END) THEN CAST(1 AS UBIGINT) << k ELSE CAST(0 AS UBIGINT) END), "
           f"lambda a, b: a | b) AS h FROM {_PIXELS})")


def _pictures(spark, sf_dir):
    pixel = lambda e: F.floor((F.least(F.greatest(e.cast("double"), F.lit(-0.5)), F.lit(0.5)) + 0.5) * 255).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", pixel).alias("g"))


def _picture(g, wide=False):
    import numpy as np

    img = np.asarray(g, np.uint8).reshape(8, 8)
    return np.concatenate([img, np.full((8, 1), 128, np.uint8)], axis=1) if wide else img


@query(f"SELECT vec_id, lower(lpad(to_hex(h), 16, '0')) AS hash FROM {_HASHES}")
def image_dhash(spark, sf_dir):
    @F.pandas_udf(T.LongType())
    def dhash(pixels: pd.Series) -> pd.Series:
        from threadmill.images import kernels

        return pd.Series([kernels.dhash(_picture(g, wide=True)) for g in pixels])

    return _pictures(spark, sf_dir).select("vec_id", hashing.hash_hex(dhash("g")).alias("hash"))


@query(f"""WITH n AS (SELECT vec_id, level, count(*) AS c FROM (SELECT vec_id, unnest(g) AS level FROM {_PIXELS}) GROUP BY ALL),
    t AS (SELECT a.vec_id, a.level, CAST(sum(b.c) FILTER (b.level <= a.level) AS DOUBLE) AS n0, CAST(sum(b.c * b.level) FILTER (b.level <= a.level) AS DOUBLE) AS s0, CAST(sum(b.c) AS DOUBLE) AS n1, CAST(sum(b.c * b.level) AS DOUBLE) AS s1
          FROM n AS a JOIN n AS b USING (vec_id) GROUP BY a.vec_id, a.level),
    v AS (SELECT vec_id, level, CASE WHEN n0 = n1 THEN -1 ELSE n0 * (n1 - n0) * pow(s0 / n0 - (s1 - s0) / (n1 - n0), 2) END AS between FROM t)
    SELECT vec_id, CAST(CASE WHEN max(between) < 0 THEN 0 ELSE min(level) FILTER (between >= best) END AS INTEGER) AS threshold FROM (SELECT *, max(between) OVER (PARTITION BY vec_id) AS best FROM v) GROUP BY vec_id""")
def image_otsu(spark, sf_dir):
    @F.pandas_udf(T.IntegerType())
    def otsu(pixels: pd.Series) -> pd.Series:
        from threadmill.images import kernels

        return pd.Series([kernels.otsu_threshold(_picture(g)) for g in pixels])

    return _pictures(spark, sf_dir).select("vec_id", otsu("g").alias("threshold"))


@query(f"""SELECT a.vec_id, list_sum(list_transform(range(1, 65), lambda i: abs(a.g[i] - b.g[i]))) / 64.0 AS mad FROM {_PIXELS} AS a JOIN {_PIXELS} AS b ON b.vec_id = a.vec_id + 1""")
def image_mean_abs_diff(spark, sf_dir):
    @F.pandas_udf(T.DoubleType())
    def mad(a: pd.Series, b: pd.Series) -> pd.Series:
        from threadmill.images import kernels

        return pd.Series([kernels.mean_abs_diff(_picture(x).tobytes(), _picture(y).tobytes()) for x, y in zip(a, b, strict=True)])

    rows = _pictures(spark, sf_dir)
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("g").alias("g2"))
    return rows.join(after, "vec_id").select("vec_id", mad("g", "g2").alias("mad"))


#: Rows of pictures that make a tall one, and the bits by which slices may differ and still be one.
TALL, SAME_BITS = 20, 28


@query(f"""WITH RECURSIVE p AS (SELECT vec_id // {TALL} AS image, vec_id % {TALL} + 1 AS index, h FROM {_HASHES}),
    r AS (SELECT image, index, FALSE AS skipped, CAST(NULL AS BIGINT) AS duplicate_of_index, h FROM p WHERE index = 1
          UNION ALL SELECT p.image, p.index, bit_count(xor(p.h, r.h)) <= {SAME_BITS}, CASE WHEN bit_count(xor(p.h, r.h)) <= {SAME_BITS} THEN p.index - 1 END, CASE WHEN bit_count(xor(p.h, r.h)) <= {SAME_BITS} THEN r.h ELSE p.h END
          FROM r JOIN p ON p.image = r.image AND p.index = r.index + 1)
    SELECT image, index, skipped, coalesce(duplicate_of_index, 0) AS duplicate_of_index FROM r""")
def slice_dedupe(spark, sf_dir):
    """Pictures stacked TALL high and cut into themselves: each slice is compared with the last one kept (0: none is like it)."""
    rows = _pictures(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / TALL).alias("image")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "g"))).alias("parts"))

    @F.pandas_udf("array<struct<index:long,skipped:boolean,duplicate_of_index:long>>")
    def cut(images: pd.Series) -> pd.Series:
        import numpy as np

        from threadmill.images import slicer

        cfg = slicer.SliceConfig(chunk_h=8, overlap=0, dedupe=True, dedupe_hamming=SAME_BITS, dedupe_mad_threshold=1e9)
        out = []
        for parts in images:
            img = np.concatenate([_picture(g, wide=True) for g in parts])
            out.append([{"index": s["index"], "skipped": s["duplicate_of"] is not None, "duplicate_of_index": s["duplicate_of"]} for s in slicer.cut(img, 8, cfg)])
        return pd.Series(out)

    return rows.select("image", F.explode(cut(F.transform("parts", lambda x: x["g"]))).alias("s")).select("image", "s.index", "s.skipped", F.coalesce("s.duplicate_of_index", F.lit(0)).alias("duplicate_of_index"))


@query(f"""WITH m AS (SELECT *, epoch_ms(timestamp_ms) AS t FROM {EV}), s AS (SELECT thread_key, sender AS k, count(*) AS n FROM m GROUP BY ALL), w AS (SELECT thread_key, dayname(t) AS k, count(*) AS n FROM m GROUP BY ALL)
    SELECT thread_key, count(*) AS n_messages, min(dt_iso)[:10] AS first_date, max(dt_iso)[:10] AS last_date, CAST(date_diff('day', min(t)::DATE, max(t)::DATE) + 1 AS INTEGER) AS days_span,
    (SELECT string_agg(k || '=' || CAST(n AS VARCHAR), ', ' ORDER BY k) FROM s WHERE s.thread_key = m.thread_key) AS per_sender, (SELECT string_agg(k || '=' || CAST(n AS VARCHAR), ', ' ORDER BY k) FROM w WHERE w.thread_key = m.thread_key) AS per_weekday
    FROM m GROUP BY thread_key""")
def full_statistics(spark, sf_dir):
    entries = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ", ")
    rows = stats.thread_statistics(ev(spark, sf_dir))
    return rows.select("thread_key", "n_messages", "first_date", "last_date", "days_span", entries("messages_per_sender").alias("per_sender"), entries("messages_per_weekday").alias("per_weekday"))


@query(f"""SELECT CASE conv_id % 4 WHEN 0 THEN 'r/d' || CAST(conv_id AS VARCHAR) WHEN 1 THEN 'r/e' || CAST(conv_id AS VARCHAR) ELSE 'r/chat_' || CAST(conv_id AS VARCHAR) || '.json' END AS thread_key,
    conv_id % 4 = 2 AS standalone, CAST(CASE WHEN conv_id % 4 = 0 THEN max(turn) // {PART} + 1 ELSE 1 END AS BIGINT) AS n_files FROM conversations WHERE conv_id % 4 < 3 GROUP BY conv_id""")
def discovered_threads(spark, sf_dir):
    """Of each four conversations: a folder of parts beside another file, one with an encrypted export's name, a file of its own, and a file that is no conversation."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.floor(F.max("turn") / PART) + 1).alias("parts"))
    kind, number = F.col("conv_id") % 4, F.col("conv_id").cast("string")
    names = (F.when(kind == 0, F.concat(F.transform(F.sequence(F.lit(1).cast("long"), "parts"), lambda i: F.format_string("d%s/message_%d.json", number, i)), F.array(F.format_string("d%s/notes.json", number))))
             .when(kind == 1, F.array(F.format_string("e%s/x_messages_1.json", number))).when(kind == 2, F.array(F.format_string("chat_%s.json", number))).otherwise(F.array(F.format_string("other_%s.json", number))))
    path = F.concat(F.lit("r/"), F.col("file"))
    raw = F.when(kind == 3, F.lit('{"x": 1}')).otherwise('{"participants": [], "messages": []}')
    files = rows.withColumn("file", F.explode(names)).select(
        path.alias("path"), F.regexp_replace(path, r"/[^/]*\z", "").alias("dir"), F.regexp_extract(path, r"([^/]*)\z", 1).alias("name"), raw.alias("raw"), F.lit("r").alias("source_id"), F.lit(0).alias("source_seq"), (kind >= 2).alias("top"))
    return discover(files).groupBy("thread_key", "standalone").agg(F.count("*").alias("n_files"))


_JSON = "'\"' || replace(replace(replace(content, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n') || '\"'"
_NL = "chr(10)"


@query(_WHOLE + f"""SELECT 'c' || thread_key || '.json' AS file, '{{' || {_NL} || '  "thread_id": "c' || thread_key || '",' || {_NL} || '  "title": "Talk ' || thread_key || '",' || {_NL} || '  "participants": [' || {_NL}
    || array_to_string(list_transform(list_sort(list(DISTINCT sender)), lambda s: '    "' || s || '"'), ',' || {_NL}) || {_NL} || '  ],' || {_NL} || '  "message_count": ' || CAST(count(*) AS VARCHAR) || ',' || {_NL}
    || '  "date_range": {{' || {_NL} || '    "first": "' || min({_ISO}) || '",' || {_NL} || '    "last": "' || max({_ISO}) || '"' || {_NL} || '  }},' || {_NL} || '  "messages": [' || {_NL}
    || string_agg('    {{' || {_NL} || '      "timestamp_ms": ' || CAST(msg_idx * {MINUTE_MS} AS VARCHAR) || ',' || {_NL} || '      "dt_iso": "' || {_ISO} || '",' || {_NL} || '      "sender": "' || sender || '",' || {_NL} || '      "content": ' || {_JSON} || ',' || {_NL}
        || '      "reactions": "",' || {_NL} || '      "attachments": "",' || {_NL} || '      "attachment_details": []' || {_NL} || '    }}', ',' || {_NL} ORDER BY msg_idx) || {_NL} || '  ]' || {_NL} || '}}' || {_NL} AS body FROM {CONV} GROUP BY thread_key)""")
def json_files(spark, sf_dir):
    return _written(spark, sf_dir, "json")


_QUOTE = lambda s: s.replace("'", "''")
_ESCAPED = "replace(replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;'), chr(10), '<br>')"


@query(_WHOLE + f"""SELECT 'c' || thread_key || '.html' AS file, '<!DOCTYPE html>' || {_NL} || '<html><head><meta charset="utf-8"><title>Talk ' || thread_key || '</title><style>{_QUOTE(sinks.STYLE)}</style></head><body>' || {_NL}
    || '<header><h1>Talk ' || thread_key || '</h1><p>' || array_to_string(list_sort(list(DISTINCT sender)), ', ') || ' · ' || CAST(count(*) AS VARCHAR) || ' messages</p><input id="q" type="search" placeholder="Search"></header>' || {_NL}
    || '<div class="day">1970-01-01</div>' || {_NL} || string_agg('<div class="m"><div class="by">' || sender || ' · ' || ({_ISO})[12:16] || '</div><div>' || {_ESCAPED} || '</div></div>' || {_NL}, '' ORDER BY msg_idx)
    || '<script>{_QUOTE(sinks.SCRIPT)}</script></body></html>' || {_NL} AS body FROM {CONV} GROUP BY thread_key)""")
def html_files(spark, sf_dir):
    return _written(spark, sf_dir, "html")


def _on_pictures(spark, sf_dir, f):
    """f of each picture, as pixels in rows."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(pixels: pd.Series) -> pd.Series:
        return pd.Series([f(_picture(g)).ravel().astype("int32") for g in pixels], dtype=object)

    return _pictures(spark, sf_dir).select("vec_id", run("g").alias("pixels"))


_CLIP = "CAST(least(greatest(round_even({}, 0), 0), 255) AS INTEGER)"


@query(f"""SELECT vec_id, list_transform(b, lambda v: {_CLIP.format("m + (v - m) * 1.25")}) AS pixels FROM (
    SELECT vec_id, b, round_even(list_sum(b) / 64.0, 0) AS m FROM (SELECT vec_id, list_transform(g, lambda v: {_CLIP.format("v * CAST(1.05 AS DOUBLE)")}) AS b FROM {_PIXELS}))""")
def image_levels(spark, sf_dir):
    from threadmill.images import kernels

    return _on_pictures(spark, sf_dir, lambda img: kernels.contrast(kernels.brightness(img, 1.05), 1.25))


@query(f"""SELECT vec_id, list_transform(range(0, 64), lambda k: list_sort(list_transform(range(0, 9), lambda j: g[8 * least(greatest(k // 8 + j // 3 - 1, 0), 7) + least(greatest(k % 8 + j % 3 - 1, 0), 7) + 1]))[5]) AS pixels FROM {_PIXELS}""")
def image_median(spark, sf_dir):
    from threadmill.images import kernels

    return _on_pictures(spark, sf_dir, kernels.median3)


@query(f"""SELECT vec_id, list_transform(list_filter(range(0, 64), lambda k: k // 8 >= 2 AND k % 8 BETWEEN 1 AND 4), lambda k: g[k + 1]) AS pixels FROM {_PIXELS}""")
def image_margin_crop(spark, sf_dir):
    from threadmill.images import kernels

    return _on_pictures(spark, sf_dir, lambda img: kernels.margin_crop(img, left=1, top=2, right=3)[0])


@query(f"SELECT vec_id, list_transform(g, lambda v: CAST(v AS INTEGER)) AS pixels FROM {_PIXELS}")
def image_png_read_back(spark, sf_dir):
    from threadmill.images import png

    return _on_pictures(spark, sf_dir, lambda img: png.decode(png.encode(img)))


@query("""SELECT doc_id, CAST(CASE WHEN n_chars % 7 = 0 THEN 1600 ELSE greatest(1000, least(2200, 38 * (n_chars % 90))) END AS INTEGER) AS height FROM documents""")
def image_chunk_height(spark, sf_dir):
    @F.pandas_udf(T.IntegerType())
    def height(lines: pd.Series) -> pd.Series:
        from threadmill.images import kernels

        return pd.Series([kernels.chunk_height(None if n % 7 == 0 else int(n % 90), 38, 1000, 2200, 1600) for n in lines])

    return table(spark, sf_dir, "documents").select("doc_id", height("n_chars").alias("height"))
