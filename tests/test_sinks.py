import csv
import json

import pytest

from threadmill import cli
from threadmill.operators.dedup import thread_ids
from threadmill.sinks import threads as sinks
from threadmill.sinks.files import safe_name
from threadmill.sources.export_reader import read_archive
from threadmill.streaming import incremental

T0 = 1702800000000


def put(root, path, n, title="A | <b>", **more):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    rows = [{"sender_name": "Ann" if i % 2 else "Bob", "timestamp_ms": T0 + i * 43_200_000, "content": f'say "{i}",\n<i>'} | more for i in range(n)]
    (root / path).write_text(json.dumps({"title": title, "participants": [{"name": "Ann"}, {"name": "Bob"}], "messages": rows}))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("in")
    put(at, "x/message_1.json", 4, photos=[{"uri": "x/photos/p.jpg"}, {"uri": "../../etc/passwd"}])
    put(at, "y/message_1.json", 2)
    (at / "x/photos").mkdir()
    (at / "x/photos/p.jpg").write_bytes(b"jpeg")
    return at


def test_formats(spark, root, tmp_path):
    a = read_archive(spark, [("s", str(root))])
    threads = thread_ids(a.threads).cache()
    for fmt in sinks.FORMATS:
        done = sinks.write_threads(a.messages, threads, str(tmp_path), fmt, self_name="ann").collect()
        assert sorted((r.file, r.n_messages) for r in done) == [(f"a_-_-b-.{fmt}", 4), (f"a_-_-b-_2.{fmt}", 2)]
    name = tmp_path / "a_-_-b-"
    md = name.with_suffix(".md").read_text()
    assert md.startswith("# A | <b>\n") and md.count("\n## ") == 4 and "**Messages:** 4" in md and "- Attachments: 2 photo(s): p.jpg, passwd" in md
    with name.with_suffix(".csv").open(newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0] == list(sinks.CSV_COLUMNS) and rows[1][2] == 'say "0",\n<i>' and len(rows) == 5
    data = json.loads(name.with_suffix(".json").read_text())
    assert data["message_count"] == 4 and data["date_range"] == {"first": "2023-12-17T08:00:00", "last": "2023-12-18T20:00:00"}
    assert [m["timestamp_ms"] for m in data["messages"]] == [T0 + i * 43_200_000 for i in range(4)] and data["messages"][0]["attachment_details"][0] == {"type": "photo", "uri": "x/photos/p.jpg", "filename": "p.jpg"}
    page = name.with_suffix(".html").read_text()
    assert page.count('class="day"') == 2 and page.count('class="m self"') == 2 and "<i>" not in page and "A | &lt;b&gt;" in page and "<br>" in page
    assert not list(tmp_path.rglob("*.part"))


def test_index_dashboard_media(spark, root, tmp_path):
    a = read_archive(spark, [("s", str(root))])
    threads = thread_ids(a.threads).cache()
    sinks.write_index(a.messages, threads, str(tmp_path), "now")
    index = (tmp_path / "INDEX.md").read_text()
    assert "**Total Messages:** 6" in index and "| 4 | A \\| <b> | 2023-12-17 to 2023-12-18 | Bob (2) | [a_-_-b-](a_-_-b-.md) |" in index
    sinks.write_dashboard(a.messages, threads, str(tmp_path), "now")
    page = (tmp_path / "STATISTICS.md").read_text()
    assert "| Bob | 3 | 50.0% |" in page and "- **Avg Words/Message:** 3.0" in page and "| 2023-12 | 6 |" in page
    media = {r.uri: r.copied for r in sinks.copy_media(a.messages, threads, {"s": str(root)}, str(tmp_path / "media")).collect()}
    assert media == {"x/photos/p.jpg": True, "../../etc/passwd": False}
    assert (tmp_path / "media/a_-_-b-/photo/p.jpg").read_bytes() == b"jpeg"
    with pytest.raises(ValueError):
        safe_name("../x")


def test_incremental(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    put(root, "x/message_1.json", 3, title="X")
    put(root, "y/message_1.json", 2, title="Y")
    assert incremental.update(spark, str(root), store) == {"run": 1, "changed_threads": 2, "unchanged_files": 0}
    assert incremental.update(spark, str(root), store) == {"run": 1, "changed_threads": 0, "unchanged_files": 2}
    put(root, "x/message_1.json", 5, title="X2")
    put(root, "z/message_1.json", 1, title="Z")
    assert incremental.update(spark, str(root), store) == {"run": 2, "changed_threads": 2, "unchanged_files": 1}
    threads, messages = incremental.current(spark, store)
    assert sorted(r.title for r in threads.collect()) == ["X2", "Y", "Z"] and messages.count() == 8
    assert incremental.stats_of(spark, store).first().files == 3


def test_stream(spark, tmp_path):
    root, store, cp = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "cp")
    put(root, "x/message_1.json", 3)
    for n in (3, 5):
        incremental.stream(spark, str(root), store, cp).awaitTermination()
        assert spark.read.parquet(store).count() == n
        put(root, "y/message_1.json", 2)
    counts = incremental.hourly_counts(spark.read.parquet(store)).collect()
    assert sum(r.n_messages for r in counts) == 5


def test_cli(spark, root, tmp_path, capsys):
    out = tmp_path / "out"
    assert cli.main(["archive", "--input", str(root)]) == 1
    assert cli.main(["archive", "--input", str(tmp_path / "none"), "--out", str(out)]) == 2
    (tmp_path / "empty").mkdir()
    assert cli.main(["archive", "--input", str(tmp_path / "empty"), "--out", str(out)]) == 3
    assert cli.main(["archive", "--input", str(root), "--out", str(out), "--after", "17.12.2023"]) == 4
    assert cli.main(["archive", "--input", str(root), "--out", str(out), "--csv", "--stats", "--limit", "5"]) == 0
    assert (out / "INDEX.md").exists() and (out / "STATISTICS.md").exists() and len(list((out / "threads_md").glob("*.md"))) == 2 and len(list((out / "threads_csv").glob("*.csv"))) == 2
    capsys.readouterr()
    assert cli.main(["archive", "--input", str(root), "--search", "SAY"]) == 0
    assert "4 matches" in capsys.readouterr().out
    assert cli.main(["archive", "--input", str(root), "--out", str(out), "--dry-run"]) == 0
    assert "DIR" in capsys.readouterr().out
    assert cli.main(["slice", "--input", str(root / "y"), "--out", str(out)]) == 3


def test_dry_run_lists_all_inputs(spark, root, tmp_path, capsys):
    put(tmp_path, "z/message_1.json", 2)
    assert cli.main(["archive", "--input", str(root), str(tmp_path), "--out", str(tmp_path / "out"), "--dry-run"]) == 0
    listed = capsys.readouterr().out.split("\n")
    assert [x.rsplit("/", 1)[-1] for x in listed if x.startswith("DIR")] == ["x", "y", "z"]


def test_incremental_runs_of_several_inputs_and_files_that_go(spark, tmp_path):
    def put(at, name):
        (tmp_path / at / name).mkdir(parents=True, exist_ok=True)
        (tmp_path / at / name / "message_1.json").write_text(json.dumps({"participants": [{"name": name}], "title": name, "messages": [{"sender_name": name, "timestamp_ms": 1702800000000, "content": f"{at} {name}"}]}))

    store = str(tmp_path / "store")
    for at, name in (("a", "x"), ("a", "y"), ("b", "z")):
        put(at, name)
    for seq, at in enumerate("ab"):
        incremental.update(spark, str(tmp_path / at), store, at, seq)
    put("a", "w")
    assert incremental.update(spark, str(tmp_path / "a"), store, "a", 0)["changed_threads"] == 1
    threads, _ = incremental.current(spark, store)
    assert [r.title for r in threads.orderBy("thread_seq").collect()] == ["w", "x", "y", "z"] and [r.thread_seq for r in threads.orderBy("thread_seq").collect()] == [0, 1, 2, 3]
    (tmp_path / "a/x/message_1.json").unlink()
    assert incremental.update(spark, str(tmp_path / "a"), store, "a", 0) == {"run": 4, "changed_threads": 1, "unchanged_files": 2}
    threads, messages = incremental.current(spark, store)
    assert {r.title for r in threads.collect()} == {"w", "y", "z"} == {r.sender for r in messages.collect()}
    facts = incremental.stats_of(spark, store).first()
    assert facts.files == 4 and facts.runs == 4 and facts.mb > 0 and facts.hit_rate == 1.0


def test_template_and_config(spark, root, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    assert cli.load_config() == cli.CONFIG
    (tmp_path / "home").mkdir()
    (tmp_path / "home/.threadmill.json").write_text('{"self_name": "Ann", "other": 1}')
    assert cli.load_config()["self_name"] == "Ann" and "other" not in cli.load_config()
    (tmp_path / ".threadmill.json").write_text('{"output_formats": ["html"], "generate_stats": true}')
    assert cli.load_config() == cli.CONFIG | {"formats": ["html"], "stats": True}
    with pytest.raises(FileNotFoundError):
        cli.load_config("none.json")
    (tmp_path / "templates").mkdir()
    (tmp_path / "templates/thread.html").write_text("<style>p{{}}</style><h1>{title}</h1><i>{participants}; {message_count}; {date_range}</i>{messages_html}<hr>{title}")
    assert cli.main(["archive", "--input", str(root), "--out", str(tmp_path / "out"), "--quiet"]) == 0
    pages = [p.read_text() for p in (tmp_path / "out/threads_html").glob("*.html")]
    assert pages and all(p.startswith("<style>p{}</style><h1>") and '<div class="day">' in p and "<hr>" in p and "<script>" not in p for p in pages)
    for bad in ("no field", "{messages_html}{messages_html}", "{messages_html}{odd}"):
        with pytest.raises((ValueError, KeyError)):
            sinks.Html(template=bad)
