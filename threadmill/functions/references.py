"""HTML references (``&eacute;``, ``&#233;``, ``&#xE9;``) resolved as Python's html.unescape does, as one SQL expression of the JVM.

A text is split at its ampersands, and each piece's beginning is looked up in a table of names and of the numbers that don't stand
for themselves. The table is one constant array of slots, by the CRC-32 of the name, so a look-up reads one short string. Nothing but
the row at hand is in memory, and no row waits for others.

Differs from html.unescape in one thing: decimal numbers of more than 4300 digits, for which Python raises an error, are beyond
Unicode like any other number above 0x10FFFF, and give U+FFFD.
"""

from __future__ import annotations

import html
import zlib
from functools import cache
from html.entities import html5

#: Characters after which a long text is cut before the next ampersand, so that the pieces of one cut are in memory at a time.
CHUNK = 1 << 16
#: Slots of the table; two or three names share one.
SLOTS = 1024
#: By far the most frequent references, as written by most tools: compared before any pattern is tried.
FREQUENT = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "#x27;": "'", "#39;": "'", "nbsp;": "\xa0"}


def slot(key: str) -> int:
    return zlib.crc32(key.encode()) % SLOTS


@cache
def table() -> str:
    """The slots, separated by blanks: ``|key=value|key=value|``, values as hexadecimal UTF-8. Numbers are keys like ``#128``."""
    entries = html5 | {f"#{n}": "" for n in html._invalid_codepoints} | {f"#{n}": s for n, s in html._invalid_charrefs.items()}
    slots = ["|"] * SLOTS
    for key, value in sorted(entries.items()):
        slots[slot(key)] += f"{key}={value.encode().hex()}|"
    return " ".join(slots)


def _let(name: str, expr: str, body: str) -> str:
    return f"element_at(transform(array({expr}), {name} -> {body}), 1)"


def _known(key: str, otherwise: str) -> str:
    """SQL: the value of a key that is in the table t."""
    mark = f"concat('|', {key}, '=')"
    value = f"CAST(unhex(substring_index(substring_index(s, {mark}, -1), '|', 1)) AS STRING)"
    return _let("s", f"get(t, CAST(pmod(crc32(CAST({key} AS BINARY)), {SLOTS}) AS INT))", f"CASE WHEN contains(s, {mark}) THEN {value} ELSE {otherwise} END")


@cache
def unescape_sql() -> str:
    """SQL of a string column x with its references resolved; null stays null."""
    # a number's digits without leading zeros; more than seven are beyond Unicode
    digits = "ltrim('0', regexp_extract(h, '[0-9a-fA-F]+', 0))"
    number = f"CASE WHEN length({digits}) > 7 THEN 1114112 ELSE CAST(conv(concat('0', {digits}), CASE WHEN lower(substr(h, 2, 1)) = 'x' THEN 16 ELSE 10 END, 10) AS INT) END"
    # a first character that goes again, as a decoder would take U+FEFF at the beginning for a mark
    char = "substr(decode(unhex(concat('00000041', lpad(hex(n), 8, '0'))), 'UTF-32'), 2)"
    beyond = "decode(unhex('EFBFBD'), 'UTF-8')"
    value = _known("concat('#', CAST(n AS STRING))", f"CASE WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN {beyond} ELSE {char} END")
    numeric = _let("h", "regexp_extract(p, '^#([xX][0-9a-fA-F]+|[0-9]+);?', 0)", f"CASE WHEN h = '' THEN concat('&', p) ELSE concat({_let('n', number, value)}, substr(p, length(h) + 1)) END")
    # names that need no semicolon: the longest one that the piece begins with
    short = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True))
    begun = _let("g", f"regexp_extract(p, '^({short})', 0)", f"CASE WHEN g = '' THEN concat('&', p) ELSE concat({_known('g', 'g')}, substr(p, length(g) + 1)) END")
    named = _let("h", "regexp_extract(p, '^[a-zA-Z][a-zA-Z0-9]{1,31};', 0)", _let("v", f"CASE WHEN h <> '' THEN {_known('h', 'NULL')} END", f"CASE WHEN v IS NULL THEN {begun} ELSE concat(v, substr(p, length(h) + 1)) END"))
    usual = " ".join(f"WHEN startswith(p, '{k}') THEN concat(CAST(unhex('{v.encode().hex()}') AS STRING), substr(p, {len(k) + 1}))" for k, v in FREQUENT.items())
    piece = f"CASE WHEN i = 0 THEN p {usual} WHEN startswith(p, '#') THEN {numeric} ELSE {named} END"
    pieces = f"array_join(transform(split(c, '&'), (p, i) -> {piece}), '')"
    chunks = f"CASE WHEN length(x) <= {CHUNK} THEN array(x) ELSE regexp_extract_all(x, '(?s).{{1,{CHUNK}}}[^&]*', 0) END"
    # the table's split is constant: Spark does it once, when it plans
    return f"CASE WHEN contains(x, '&') THEN {_let('t', f"split('{table()}', ' ')", f"array_join(transform({chunks}, c -> {pieces}), '')")} ELSE x END"
