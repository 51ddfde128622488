import json

import pytest
from pyspark.sql import functions as F

from threadmill.operators import dedup, filters, stats
from threadmill.sources.export_reader import read_archive

T0 = 1702800000000  # 2023-12-17T08:00:00 UTC


def message(i, sender="Ann", **more):
    return {"sender_name": sender, "timestamp_ms": T0 + 60_000 * i, "content": f"m{i}"} | more


def export(messages, title="Ann and Bob", people=("Bob", "Ann"), **more):
    return {"participants": [{"name": p} for p in people], "title": title, "messages": messages} | more


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("export")

    def put(path, data, raw=None):
        (at / path).parent.mkdir(parents=True, exist_ok=True)
        (at / path).write_bytes(raw if raw is not None else json.dumps(data, ensure_ascii=False).encode())

    put("inbox/ab/message_1.json", export([message(i, "Ann" if i % 2 else "Bob") for i in range(6)]))
    put("inbox/ab/message_2.json", export([message(5, "Cy", content="tie")], title=""))
    put("inbox/ab/message_10.json", export([message(5, "Dee", content="earlier in name order")], title="Later title"))
    put("inbox/ab/notes.json", {"not": "read"})
    shapes = [
        message(0, photos=[{"uri": "a/b/p1.jpg?x=1"}, {"uri": ""}], content=None), message(1, videos=[{"uri": "v.mp4", "thumbnail": {"uri": "t.jpg"}}], audio_files=[{"uri": "x/a.aac"}]),
        message(2, gifs=[{"uri": ""}], files=[{"uri": "f.pdf"}]), message(3, sticker={"uri": "s.png"}), message(4, share={"link": "http://l", "share_text": "a &amp; b"}), message(5, share={"share_text": "t"}),
        message(6, reactions=[{"reaction": "x", "actor": "Bob"}, {"reaction": "y"}, {"actor": "nobody"}], content=""), message(7, content="   "), message(8, share="odd", content=""),
        {"senderName": "Zed", "timestamp": str(T0 + 600_000), "text": "alt keys"}, {"sender_name": "", "timestamp_ms": T0 + 1.9, "content": "float"}, {"sender_name": "n", "timestamp_ms": "x", "content": "dropped"}, {"content": "no time"},
        message(11, content="naÃ¯ve Ã© &lt;b&gt;\r\n\r\n\r\n\r\n\r\nend \t x  \x07\n"), message(12, content="Ã© ł"), message(13, content="Ähre"),
    ]
    put("inbox/shapes/message_1.json", export(shapes, people=("Bob", "Zed")))
    good = json.dumps(export([message(0), message(1)], people=("P", "Q")), indent=1)
    put("broken/comma/message_1.json", None, good.replace('"m1"\n', '"m1",\n').encode())
    put("broken/missing/message_1.json", None, b'{"title": "M", "participants": [], "messages": [{"content": "a", "timestamp_ms": 1702800000000\n "sender_name": "S"}]}')
    put("broken/truncated/message_1.json", None, b'{"title": "T", "participants": [], "messages": [{ "sender_name": "S1", "timestamp_ms": 1702800000000 "sender_name": "S2", "timestamp_ms": 1702800060000, "content": "second, ] in text"}]}')
    put("broken/newlines/message_1.json", None, b'{"title": "N", "participants": ["A", "B"], "messages": [{"sender_name": "S", "timestamp_ms": 1702800000000, "content": "one\ntwo\nthree"}]}')
    put("broken/hopeless/message_1.json", None, b'{"title": "H", "messages": [{"content": ')
    put("broken/list/message_1.json", None, b"[1, 2]")
    put("broken/latin1/message_1.json", None, '{"title": "Été", "participants": [], "messages": [{"sender_name": "S", "timestamp_ms": 1702800000000, "content": "café"}]}'.encode("latin-1"))
    put("alone_1.json", {"threadName": "", "participants": ["Bob", "Ann"], "messages": [message(0, content="alone")]})
    put("other.json", {"x": 1})
    put("e2ee/bob_messenger_logs_1.json", export([message(0, content="e2ee")], title="", people=()))
    return str(at)


@pytest.fixture(scope="module")
def archive(spark, root):
    return read_archive(spark, [("main", root)])


def rows(archive, end):
    return archive.messages.where(F.endswith("thread_key", F.lit(end))).orderBy("timestamp_ms", "file_seq", "msg_idx").collect()


def test_discovery_and_order(archive):
    threads = {r.thread_key.rsplit("/", 1)[1]: r for r in archive.threads.collect()}
    assert set(threads) == {"ab", "shapes", "comma", "missing", "truncated", "newlines", "latin1", "alone_1.json", "e2ee"}
    assert threads["ab"].title == "Later title" and threads["ab"].participants == ["Ann", "Bob"]
    assert threads["alone_1.json"].title == "alone" and threads["e2ee"].title == "e2ee" and threads["latin1"].title == "Été"
    # message_10 is before message_2 by name, so its tie comes first
    assert [r.sender for r in rows(archive, "/ab")][-3:] == ["Ann", "Dee", "Cy"]


def test_titles_follow_file_order(archive):
    assert [r.file_seq for r in rows(archive, "/ab")] == [0] * 6 + [1, 2]


def test_shapes(archive):
    got = rows(archive, "/shapes")
    assert len(got) == 12 and len(archive.messages.where("content = 'dropped' or content = 'no time'").collect()) == 0
    by = {r.timestamp_ms: r for r in got}
    at = lambda i: by[T0 + 60_000 * i]
    assert at(0).attachments == "2 photo(s): p1.jpg" and [d.filename for d in at(0).attachment_details] == ["p1.jpg", ""]
    assert at(1).attachments == "1 video(s): v.mp4; 1 audio: a.aac" and at(1).attachment_details[0].thumbnail == "t.jpg"
    assert at(2).attachments == "1 file(s): f.pdf; 1 gif(s)" and at(2).attachment_details[1].filename is None
    assert at(3).attachments == "sticker" and at(3).attachment_details[0].uri == "s.png"
    assert at(4).attachments == "share: http://l" and at(4).attachment_details[0].text == "a &amp; b" and at(5).attachments == "share"
    assert at(6).reactions == "x by Bob; y" and at(6).content == ""
    assert T0 + 60_000 * 7 not in by and T0 + 60_000 * 8 not in by
    assert at(10).sender == "Zed" and at(10).content == "alt keys"
    assert by[T0 + 1].sender == "(unknown)"
    assert at(11).content == "naïve é <b>\n\n\nend x" and at(12).content == "Ã© ł" and at(13).content == "Ähre"
    assert at(11).dt_iso == "2023-12-17T08:11:00"


def test_repairs_and_rejects(archive):
    assert [r.content for r in rows(archive, "/comma")] == ["m0", "m1"]
    assert [r.sender for r in rows(archive, "/missing")] == ["S"]
    assert [r.content for r in rows(archive, "/newlines")] == ["one\ntwo\nthree"]
    assert [r.content for r in rows(archive, "/truncated")] == ["second, ] in text"]  # the first one has no content, so it is dropped
    assert [r.content for r in rows(archive, "/latin1")] == ["café"]
    assert {r.path.split("/")[-2] for r in archive.rejects.collect()} == {"hopeless", "list"}
    fixes = {r.path.split("/")[-2]: r.fixes for r in archive.fixes.collect()}
    assert fixes == {"comma": ["removed trailing commas"], "missing": ["added a missing comma before sender_name"], "truncated": ["closed a truncated message"], "latin1": ["read as Latin-1"]}


def test_limit_dates_and_sources(spark, root):
    assert read_archive(spark, root, limit=2).threads.count() == 1  # the second of the two is rejected
    day = "2023-12-17"
    assert read_archive(spark, root, after=day, before=day).messages.count() == 0
    assert read_archive(spark, root, after=day, before=day, before_inclusive_day=True).messages.count() > 10
    two = read_archive(spark, [("a", root), ("b", root + "/inbox")])
    assert {r.source_id: r.n_threads for r in stats.source_totals(two.messages).collect()} == {"a": 9, "b": 2, None: 11}
    assert two.threads.count() == two.threads.select("thread_key").distinct().count() == 11
    with pytest.raises(filters.BadDate):
        read_archive(spark, root, after="17.12.2023").messages.count()


def test_statistics(archive):
    got = {r.thread_key.rsplit("/", 1)[1]: r for r in stats.thread_statistics(archive.messages, archive.threads).collect()}
    ab = got["ab"]
    assert ab.n_messages == 8 and ab.days_span == 1 and ab.messages_per_sender == {"Ann": 3, "Bob": 3, "Cy": 1, "Dee": 1}
    assert ab.messages_per_hour == {"8": 8} and ab.messages_per_weekday == {"Sunday": 8} and ab.messages_per_month == {"2023-12": 8}
    assert ab.n_responses == 5 and ab.avg_minutes == 1.0
    assert ab.longest_message.sender == "Dee" and ab.most_active_day["count"] == 8
    assert got["shapes"].attachments_by_type == {"photo": 2, "video": 1, "audio": 1, "file": 1, "gif": 1, "sticker": 1, "share": 2}


def test_duplicates_and_merge(archive):
    groups = {r.participants: sorted(k.rsplit("/", 1)[1] for k in r.thread_keys) for r in dedup.duplicate_groups(archive.threads).collect()}
    assert groups == {"Ann, Bob": ["ab", "alone_1.json"]}
    threads, messages = dedup.merge(archive.threads, archive.messages)
    assert threads.count() == 8
    merged = messages.where(F.endswith("thread_key", F.lit("/ab")))
    assert merged.count() == 9 and merged.where("content = 'alone'").count() == 1


def test_unique_ids(spark):
    names = ["x", "x_2", "x", "x", "y", "x_2", "y_1", "y", "x_2_2"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "k int, n string")
    got = [r.thread_id for r in dedup.unique_ids(df, "k", F.col("n"), "k").orderBy("k").collect()]
    assert got == ["x", "x_2", "x_3", "x_4", "y", "x_2_2", "y_1", "y_2", "x_2_2_2"]


def test_many_threads_and_large_places(spark):
    from threadmill.schema import THREADS
    from threadmill.sources.export_reader import from_table

    rows = spark.range(5000).selectExpr("id", "'same' as role", "concat('m', id) as text", "id + 3000000000 as place")
    messages = from_table(rows, F.col("id"), F.col("role"), F.col("text"), F.col("id"), F.col("place"))
    threads = rows.selectExpr("cast(id as string) as thread_key", "'table' as source_id", "0 as source_seq", "cast(id as int) as thread_seq", "'' as title", "array('same') as participants").select(*THREADS.names)
    one, merged = dedup.merge(threads, messages)
    assert one.count() == 1
    got = merged.orderBy("file_seq").collect()
    assert len(got) == 5000 and [r.content for r in got] == [f"m{i}" for i in range(5000)]
    assert got[-1].file_seq == 4999 * dedup.FILES_OF_A_THREAD and got[-1].msg_idx == 3_000_004_999
