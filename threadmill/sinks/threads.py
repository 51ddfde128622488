"""A file for each thread: Markdown, CSV, JSON or HTML. And the archive's index and statistics pages.

Messages are dealt by thread, sorted, and streamed into the thread's file, so a thread of any length needs little memory. What
a file says before its messages (counts, dates) is aggregated first. A row comes back for each file written.
"""

from __future__ import annotations

import csv
import html
import io
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.functions.text import html_lines
from threadmill.operators import stats
from threadmill.schema import ORDER
from threadmill.session import saved
from threadmill.sinks.files import Output, file_system, safe_name

NO_TEXT, NOBODY = "*(no text)*", "(unknown)"
CSV_COLUMNS = ("dt_iso", "sender", "content", "reactions", "attachments", "timestamp_ms")


class Markdown:
    suffix = "md"

    def head(self, t):
        people = ", ".join(t.participants) or NOBODY
        yield f"# {t.title}\n\n**Thread ID:** `{t.thread_id}`\n**Participants:** {people}\n**Messages:** {t.n_messages}\n\n---\n"

    def message(self, m, _first):
        notes = [f"- {name}: {value}\n" for name, value in (("Reactions", m.reactions), ("Attachments", m.attachments)) if value]
        yield f"\n## {m.dt_iso} — {m.sender}\n{''.join(notes)}\n{m.content or NO_TEXT}\n\n---\n"

    def tail(self, t):
        return ()


class Csv:
    suffix = "csv"

    @staticmethod
    def line(values):
        out = io.StringIO()
        csv.writer(out).writerow(values)
        return out.getvalue()

    def head(self, t):
        yield self.line(CSV_COLUMNS)

    def message(self, m, _first):
        yield self.line([getattr(m, c) for c in CSV_COLUMNS])

    def tail(self, t):
        return ()


class Json:
    suffix = "json"
    fields = ("timestamp_ms", "dt_iso", "sender", "content", "reactions", "attachments")

    def head(self, t):
        facts = {"thread_id": t.thread_id, "title": t.title, "participants": list(t.participants), "message_count": int(t.n_messages), "date_range": {"first": t.first_iso, "last": t.last_iso}}
        yield json.dumps(facts, ensure_ascii=False, indent=2)[:-2] + ',\n  "messages": ['

    def message(self, m, first):
        details = [{k: v for k, v in d.items() if v is not None} for d in m.attachment_details]
        text = json.dumps({c: getattr(m, c) for c in self.fields} | {"attachment_details": details}, ensure_ascii=False, indent=2)
        yield ("\n" if first else ",\n") + "\n".join("    " + line for line in text.split("\n"))

    def tail(self, t):
        yield "\n  ]\n}\n"


STYLE = ("body{font:15px/1.45 sans-serif;max-width:46rem;margin:2rem auto;padding:0 1rem;background:#fafafa;color:#222}header{margin-bottom:1rem}"
         ".day{text-align:center;color:#777;margin:1.2rem 0 .4rem}.m{border:1px solid #ddd;border-radius:.5rem;padding:.4rem .7rem;margin:.3rem 4rem .3rem 0;background:#fff}"
         ".m.self{margin:.3rem 0 .3rem 4rem;background:#e8f1ff}.by{color:#666;font-size:.85em}.note{color:#666;font-size:.85em}.m.off{display:none}mark{background:#ffe27a}")
SCRIPT = """const box=document.getElementById('q'),all=[...document.querySelectorAll('.m')].map(e=>[e,e.innerHTML,e.textContent.toLowerCase()]);
box.addEventListener('input',()=>{const q=box.value.toLowerCase();for(const [e,was,text] of all){e.innerHTML=was;const hit=!q||text.includes(q);e.classList.toggle('off',!hit);
if(q&&hit){const walk=document.createTreeWalker(e,NodeFilter.SHOW_TEXT),found=[];while(walk.nextNode())found.push(walk.currentNode);
for(const n of found){const at=n.data.toLowerCase().indexOf(q);if(at>=0){const r=document.createRange();r.setStart(n,at);r.setEnd(n,at+q.length);r.surroundContents(document.createElement('mark'));}}}}});"""


class Html:
    """Everything from the archive is escaped. ``self_name`` marks senders that contain it, case aside; without it none.

    template: a page of one's own, with the fields {title}, {participants}, {message_count}, {date_range} and, once,
    {messages_html}; other braces are doubled.
    """

    suffix = "html"

    def __init__(self, self_name: str | None = None, template: str | None = None):
        self.self_name, self.day, self.parts = (self_name or "").lower(), None, None
        if template is not None:
            self.parts = template.split("{messages_html}")
            if len(self.parts) != 2:
                raise ValueError("a template has the field {messages_html} once")
            for part in self.parts:  # unknown fields and single braces show before anything is written
                part.format(title="", participants="", message_count=0, date_range="")

    def filled(self, i, t):
        dates = f"{t.first_iso[:10]} to {t.last_iso[:10]}"
        return self.parts[i].format(title=html.escape(t.title), participants=html.escape(", ".join(t.participants)), message_count=t.n_messages, date_range=dates)

    def head(self, t):
        self.day = None
        if self.parts:
            yield self.filled(0, t)
            return
        title = html.escape(t.title)
        yield (f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{title}</title><style>{STYLE}</style></head><body>\n<header><h1>{title}</h1>'
               f'<p>{html.escape(", ".join(t.participants) or NOBODY)} · {t.n_messages} messages</p><input id="q" type="search" placeholder="Search"></header>\n')

    def message(self, m, _first):
        day = m.dt_iso[:10]
        if day != self.day:
            self.day = day
            yield f'<div class="day">{day}</div>\n'
        mine = " self" if self.self_name and self.self_name in m.sender.lower() else ""
        notes = "".join(f'<div class="note">{html.escape(v)}</div>' for v in (m.reactions, m.attachments) if v)
        yield f'<div class="m{mine}"><div class="by">{html.escape(m.sender)} · {m.dt_iso[11:16]}</div><div>{m.content_html}</div>{notes}</div>\n'

    def tail(self, t):
        yield self.filled(1, t) if self.parts else f"<script>{SCRIPT}</script></body></html>\n"


FORMATS = {"md": Markdown, "csv": Csv, "json": Json, "html": Html}
WRITTEN = "thread_key string, thread_id string, file string, n_messages long, n_bytes long"


def write_threads(messages: DataFrame, threads: DataFrame, out: str, fmt: str, self_name: str | None = None, template: str | None = None) -> DataFrame:
    """Writes ``out/<thread_id>.<fmt>`` for each thread. threads needs thread_id (see operators.dedup.thread_ids). Lazy: an action writes.
    template: the text of an HTML page (see Html)."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    make = (lambda: Html(self_name, template)) if fmt == "html" else FORMATS[fmt]
    make()
    facts = messages.groupBy("thread_key").agg(F.count("*").alias("n_messages"), F.min(F.struct(*ORDER, "dt_iso"))["dt_iso"].alias("first_iso"), F.max(F.struct(*ORDER, "dt_iso"))["dt_iso"].alias("last_iso"))
    heads = threads.select("thread_key", "thread_id", "title", "participants").join(facts, "thread_key")
    rows = messages.select("thread_key", *ORDER, "dt_iso", "sender", "content", "reactions", "attachments", "attachment_details", html_lines("content").alias("content_html"))
    # a head is a row before its thread's first message
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != "thread_key"]
    head = heads.select("thread_key", *none, F.struct("thread_id", "title", "participants", "n_messages", "first_iso", "last_iso").alias("head"))
    both = head.unionByName(rows.withColumn("head", F.lit(None).cast(head.schema["head"].dataType)))
    dealt = both.repartition("thread_key").sortWithinPartitions("thread_key", *[F.col(c).asc_nulls_first() for c in ORDER])

    def run(batches):
        writer, key, thread, file, first = make(), None, None, None, True

        def close():
            for part in writer.tail(thread):
                file.write(part)
            file.__exit__(None, None, None)
            return key, thread.thread_id, f"{thread.thread_id}.{writer.suffix}", int(thread.n_messages), file.n

        try:
            for batch in batches:
                done = []
                for m in batch.itertuples(index=False):
                    if m.head is not None:
                        if file is not None:
                            done.append(close())
                        key, thread, first = m.thread_key, pd.Series(m.head | {"n_messages": int(m.head["n_messages"])}, dtype=object), True
                        file = Output(out, f"{thread.thread_id}.{writer.suffix}")
                        for part in writer.head(thread):
                            file.write(part)
                    elif m.thread_key == key:
                        for part in writer.message(m._replace(timestamp_ms=int(m.timestamp_ms)), first):
                            file.write(part)
                        first = False
                if done:
                    yield pd.DataFrame(done, columns=[c.split()[0] for c in WRITTEN.split(", ")]).astype(object)
            if file is not None:
                last, file = close(), None
                yield pd.DataFrame([last], columns=[c.split()[0] for c in WRITTEN.split(", ")]).astype(object)
        except BaseException as e:
            if file is not None and not file.stream.closed:
                file.__exit__(type(e), e, None)
            raise

    return dealt.mapInPandas(run, WRITTEN)


def _cell(text) -> str:
    return str(text).replace("|", "\\|").replace("\n", " ")


def write_index(messages: DataFrame, threads: DataFrame, out: str, generated: str, name: str = "INDEX.md") -> None:
    """The threads with most messages first; a section for each source if there are several. Rows are streamed through the driver."""
    total = stats.source_totals(messages).orderBy(F.col("source_id").isNotNull(), "source_id").toLocalIterator()
    whole = next(iter(total), None)
    rows = saved(stats.index(messages, threads))  # once for all sources
    with Output(out, name) as f:
        f.write(f"# Archive index\n\n**Generated:** {generated}\n**Total Threads:** {whole.n_threads if whole else 0:,}\n**Total Messages:** {whole.n_messages if whole else 0:,}\n")
        for source in total:
            f.write(f"\n## {_cell(source.source_id)}: {source.n_threads:,} threads, {source.n_messages:,} messages\n\n| Messages | Thread | Date Range | Top Sender | File |\n|---:|---|---|---|---|\n")
            for r in rows.where(F.col("source_id") == source.source_id).orderBy(F.desc("n_messages"), "thread_seq").toLocalIterator():
                dates = f"{r.first_date} to {r.last_date}"
                f.write(f"| {r.n_messages:,} | {_cell(r.title)} | {dates} | {_cell(r.top_sender)} ({r.top_count}) | [{r.thread_id}]({r.thread_id}.md) |\n")


def write_dashboard(messages: DataFrame, threads: DataFrame, out: str, generated: str, name: str = "STATISTICS.md") -> None:
    """Totals, senders, months and threads. Rates are rounded as Python rounds."""
    total = stats.dashboard(messages).where("kind = 'total'").first()
    n, words = total.n_messages, total.n_words
    per_thread = stats.text_stats(messages).join(stats.most_active_day(messages).select("thread_key", "day", F.col("n_messages").alias("day_count")), "thread_key")
    per_thread = threads.join(per_thread, "thread_key").orderBy(F.desc("n_messages"), "thread_seq")
    with Output(out, name) as f:
        f.write(f"# Statistics\n\n**Generated:** {generated}\n\n- **Total Messages:** {n:,}\n- **Total Words:** {words:,}\n- **Total Threads:** {threads.count():,}\n")
        if n:
            f.write(f"- **Avg Words/Message:** {words / n:.1f}\n")
        f.write("\n## Messages by Sender\n\n| Sender | Messages | % |\n|---|---:|---:|\n")
        for r in stats.top_senders(messages).collect():
            f.write(f"| {_cell(r.sender)} | {r.n_messages:,} | {r.percent:.1f}% |\n")
        f.write("\n## Messages by Month\n\n| Month | Messages |\n|---|---:|\n")
        for r in stats.last_months(messages).orderBy("month").collect():
            f.write(f"| {r.month} | {r.n_messages:,} |\n")
        f.write("\n## Threads\n\n| Thread | Messages | Words | Avg Length | Most Active Day |\n|---|---:|---:|---:|---|\n")
        for r in per_thread.toLocalIterator():
            f.write(f"| {_cell(r.title[:stats.TITLE_SHOWN])} | {r.n_messages:,} | {r.n_words:,} | {r.avg_length:.0f} | {r.day} ({r.day_count}) |\n")


def copy_media(messages: DataFrame, threads: DataFrame, roots: dict[str, str], out: str) -> DataFrame:
    """Copies attachments to ``out/<thread_id>/<type>/<file name>``; a row (thread_id, uri, copied) for each.

    roots: source_id -> folder. A uri is looked for below the root and below its parent; files that are there already stay.
    Uris that leave their folder are not followed.
    """
    wanted = messages.select("thread_key", "source_id", F.explode("attachment_details").alias("d")).where("d.uri <> ''").select("thread_key", "source_id", F.col("d.type").alias("type"), F.col("d.uri").alias("uri")).distinct()
    wanted = wanted.join(threads.select("thread_key", "thread_id"), "thread_key").select("source_id", "thread_id", "type", "uri")

    def run(batches):
        for batch in batches:
            done = []
            for source, thread, kind, uri in zip(batch["source_id"], batch["thread_id"], batch["type"], batch["uri"], strict=True):
                copied = False
                try:
                    name = safe_name(uri.split("?")[0])
                    system, root = file_system(roots[source])
                    target, base = file_system(out)
                    to = f"{thread}/{kind}/{name.rsplit('/', 1)[-1]}"
                    there = target.get_file_info(f"{base}/{to}").is_file
                    for folder in (root, root.rstrip("/").rsplit("/", 1)[0]):
                        if not there and not copied and system.get_file_info(f"{folder}/{name}").is_file:
                            with system.open_input_stream(f"{folder}/{name}") as src, Output(out, to) as dst:
                                while data := src.read(1 << 20):
                                    dst.write(data)
                            copied = True
                except ValueError:
                    pass
                done.append((thread, uri, copied))
            yield pd.DataFrame(done, columns=["thread_id", "uri", "copied"]).astype(object)

    return wanted.mapInPandas(run, "thread_id string, uri string, copied boolean")
