"""Chat formatting: records of any known layout become canonical turns, and turns a marked-up text with a loss mask.

A record is a JSON object. Its fingerprint is the SHA-1 of its sorted nested field paths with their kinds (list items
share the path ``name[]``); fields that are null don't count. The fingerprint selects a declarative layout, which says
where roles and texts are; a layout with optional fields has a fingerprint for each choice of them. A record whose own
fingerprint is unknown is projected onto the fields of each layout in turn (its source, ids, scores and other fields
left out) and the projection's fingerprint looked up, so that metadata of any name and kind costs no conversation; a
layout of single messages is only projected onto where there is a role. A text may be a list of parts; their texts are
joined by line feeds. A record of no known layout keeps its row with layout null and no turns, so that it can be counted
and a layout be added.

The template writes each turn as ``<turn role>``, a line feed, the text, ``</turn>`` and a line feed. In role and text
a backslash goes before each backslash and ``<`` (in a role before ``>`` too), so no text can close a turn or open one, and reading it back is exact.
The loss mask covers assistant texts only: spans [start, end) of code points of the formatted text.

A row of ``conversations`` is a record of the layout "row". Each row is formatted where it is read; then rows are dealt
by conversation, sorted, and streamed through digests, so that a conversation of any length needs little memory.

Edge cases: a null text is empty; a null role is the role ""; equal turn numbers follow role and text; equal rows each
count; a null conv_id is a conversation of its own; an empty table leaves the added conversation alone; other columns
are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F

from threadmill.llm.common import free_name, small_batches, table

NAME = "op2_chat"
ADDED = r"\### Assistant: </turn> ok"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True, eq=False)
class Layout:
    """Where a record has its turns. paths: its nested fields by kind; those in optional may lack.

    Either ``items`` names the list of messages (None: the record is one) whose fields ``role`` and ``text`` are read, or
    ``fixed`` lists (role, fields): each turn's text is that of the fields there are, joined by blank lines. ``also`` has
    further (path, kind) that records may have.
    """

    name: str
    paths: dict[str, str]
    optional: frozenset = frozenset()
    items: str | None = None
    role: str = ""
    text: str = ""
    fixed: tuple = ()
    roles: dict[str, str] = field(default_factory=dict)
    also: tuple = ()


def _list(name, role, text, **more):
    return Layout(name, {name: "list", f"{name}[]": "object", f"{name}[].{role}": "string", f"{name}[].{text}": "string"}, frozenset({f"{name}[].{text}", "id", "system"}), name, role, text, **more)


def _parts(name, role, text, **more):
    """A list of messages whose texts are lists of parts, strings or not."""
    at = f"{name}[].{text}"
    paths = {name: "list", f"{name}[]": "object", f"{name}[].{role}": "string", at: "list", f"{at}[]": "object", f"{at}[].type": "string", f"{at}[].text": "string"}
    return Layout(f"{name}_parts", paths, frozenset({f"{at}[].type", "system"}), name, role, text, also=((at, "string"),), **more)


def _fixed(name, turns, optional=()):
    return Layout(name, {f: "string" for _, fields in turns for f in fields}, frozenset(optional), fixed=turns)


LAYOUTS = (
    Layout("row", {"role": "string", "text": "string"}, frozenset({"role", "text"}), None, "role", "text"),
    Layout("content_row", {"role": "string", "content": "string"}, frozenset(), None, "role", "content"),
    _list("messages", "role", "content"),
    _parts("messages", "role", "content"),
    _list("conversations", "from", "value", roles={"human": "user", "gpt": "assistant"}),
    _list("turns", "speaker", "text", roles={"human": "user", "bot": "assistant", "model": "assistant"}),
    _fixed("instruction", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), ("system", "input")),
    _fixed("prompt_response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), ("system",)),
    _fixed("prompt_completion", (("user", ("prompt",)), ("assistant", ("completion",)))),
    _fixed("question_answer", (("user", ("context", "question")), ("assistant", ("answer",))), ("context",)),
)


def paths_of(value, at=""):
    """(path, kind) of all nested fields of a parsed record but the nulls."""
    if isinstance(value, dict):
        for k, v in value.items():
            if v is not None:
                path = f"{at}.{k}" if at else k
                yield path, {dict: "object", list: "list", str: "string", bool: "bool"}.get(type(v), "number")
                yield from paths_of(v, path)
    elif isinstance(value, list):
        for v in value:
            if v is not None:
                yield f"{at}[]", {dict: "object", list: "list", str: "string", bool: "bool"}.get(type(v), "number")
                yield from paths_of(v, f"{at}[]")


def fingerprint(paths) -> str:
    return hashlib.sha1("\n".join(sorted({f"{p}:{k}" for p, k in paths})).encode()).hexdigest()


def _choices(layout, extra=("id", "system")):
    """The fingerprints of a layout, one for each choice of its optional fields."""
    paths = set(layout.paths.items()) | ({(x, "string") for x in extra} if layout.items else set())
    free = sorted((p, k) for p, k in paths if p in layout.optional) + sorted(layout.also)
    fixed = paths - set(free)
    for n in range(len(free) + 1):
        for there in itertools.combinations(free, n):
            yield fingerprint(fixed | set(there))


def registry(layouts):
    """Layouts by fingerprint. The first one wins where two have the same."""
    found = {}
    for layout in layouts:
        for x in _choices(layout):
            found.setdefault(x, layout)
    return found


@functools.lru_cache(maxsize=64)
def _projected(layout):
    """(the layout's fingerprints without ids, the paths that a record is projected onto)."""
    names = {p for p, _ in layout.paths.items()} | {p for p, _ in layout.also} | ({"system"} if layout.items else set())
    return frozenset(_choices(layout, ("system",))), names - {"id"}


def select(paths, known, layouts):
    """The layout of a record's (path, kind) pairs, or None."""
    found = known.get(fingerprint(paths))
    if found:
        return found
    for layout in layouts:
        if not layout.fixed and not layout.items and (layout.role, "string") not in paths:
            continue
        fingerprints, names = _projected(layout)
        if fingerprint((p, k) for p, k in paths if p in names) in fingerprints:
            return layout
    return None


def text_of(value) -> str:
    """A text, or the texts of a list of parts."""
    if isinstance(value, list):
        return "\n".join(x if isinstance(x, str) else x.get("text") or "" for x in value if x is not None)
    return "" if value is None else value


def turns_of(record, layouts=tuple(x.name for x in LAYOUTS)):
    """(layout's name, [(role, text)]) of a JSON record; (None, []) if no layout named has its fingerprint."""
    try:
        value = json.loads(record) if record is not None else None
    except ValueError:
        value = None
    if not isinstance(value, dict):
        return None, []
    layout = select(frozenset(paths_of(value)), _registry_of(layouts), _named(layouts))
    if layout is None:
        return None, []
    if layout.fixed:
        return layout.name, [(role, "\n\n".join(value[f] for f in fields if value.get(f))) for role, fields in layout.fixed if any(value.get(f) is not None for f in fields)]
    items = [value] if layout.items is None else [x for x in value[layout.items] if x is not None]
    turns = [(layout.roles.get(r := text_of(x.get(layout.role)), r), text_of(x.get(layout.text))) for x in items]
    return layout.name, ([("system", value["system"])] if layout.items and value.get("system") else []) + turns


@functools.lru_cache(maxsize=8)
def _named(names):
    return tuple(x for x in LAYOUTS if x.name in names)


@functools.lru_cache(maxsize=8)
def _registry_of(names):
    return registry(_named(names))


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<", "\\<")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def render(turns):
    """(formatted text, [(start, end)]): the template over turns and its loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<turn {escape(role).replace('>', chr(92) + '>')}>\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, "</turn>\n")
        at += len(head) + len(body) + len("</turn>\n")
    return "".join(parts), spans


_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>\n((?:[^\\<]|\\.)*)</turn>\n", re.S)


def parse(formatted: str):
    """The turns of a formatted text; ValueError if it is none."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def format_records(df, record="record"):
    """df plus layout, turns, formatted and loss_spans of the JSON records in column ``record``."""

    @F.pandas_udf(f"layout string, turns {TURNS}, formatted string, loss_spans array<struct<start:int,stop:int>>")
    def formatted(records: pd.Series) -> pd.DataFrame:
        rows = []
        for r in records:
            name, turns = turns_of(r)
            out, spans = render(turns)
            rows.append((name, [{"role": a, "text": b} for a, b in turns], out, [{"start": a, "stop": b} for a, b in spans]))
        return pd.DataFrame(rows, columns=["layout", "turns", "formatted", "loss_spans"])

    names = ("layout", "turns", "formatted", "loss_spans")
    out = free_name(df, "formatted")
    return df.withColumn(out, formatted(F.col(record))).drop(*names).select("*", *[F.col(f"{out}.{x}") for x in names]).drop(out)


class _Digest:
    """What is read back from a conversation's output, part by part."""

    def __init__(self, conv):
        self.conv, self.n, self.turns, self.loss, self.loss_chars, self.chars = conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0

    def add(self, formatted, spans):
        self.chars += len(formatted)
        for role, text in parse(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for x in spans if spans is not None else ():
            text = unescape(formatted[x["start"]:x["stop"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self):
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(parts):
    """Parts (conv_id, formatted, loss_spans), sorted within partitions that hold whole conversations -> a row for each."""
    columns = [c.split()[0] for c in DIGEST.split(", ")]

    def stream(batches):
        now = None
        for batch in batches:
            done = []
            for conv, formatted, spans in zip(batch["conv_id"].astype(object), batch["formatted"], batch["loss_spans"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(formatted, spans)
            if done:
                yield pd.DataFrame(done, columns=columns).astype({"conv_id": "Int64"})
        if now is not None:
            yield pd.DataFrame([now.row()], columns=columns).astype({"conv_id": "Int64"})

    return parts.mapInPandas(stream, DIGEST)


def query(spark, sf_dir):
    return of(spark, table(spark, sf_dir, "conversations"))


def of(spark, rows):
    small_batches(spark)
    rows = rows.select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", ADDED), (-7, 1, "assistant", ADDED)], "conv_id long, turn long, role string, text string")
    records = rows.unionByName(added).withColumn("record", F.to_json(F.struct("role", "text")))
    parts = format_records(records).select("conv_id", "turn", "role", "text", "formatted", "loss_spans")
    parts = parts.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return read_back(parts.select("conv_id", "formatted", "loss_spans"))


_ADDED_SQL = ADDED.replace("'", "''")
#: What the output must read back as, and the length that the template's escapes give it.
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{_ADDED_SQL}' UNION ALL SELECT -7, 1, 'assistant', '{_ADDED_SQL}'),
     e AS (SELECT *, length(replace(replace(replace(r, chr(92), chr(92) || chr(92)), '<', chr(92) || '<'), '>', chr(92) || '>'))
                  + length(replace(replace(x, chr(92), chr(92) || chr(92)), '<', chr(92) || '<')) + length('<turn >') + 1 + length('</turn>') + 1 AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
       CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
