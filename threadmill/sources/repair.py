"""Repair of damaged export JSON with column expressions.

A file is parsed as it is; only where that fails is its text repaired and parsed again. Each repair that changed the text is
named in ``fixes``. Raw line feeds inside strings need no repair: the parser is told to allow them, however many there are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill.functions.text import col
from threadmill.schema import EXPORT

# What the damage looks like.
MISSING_COMMA = r'(\d+)[ \t]*\r?\n(\s*"sender_name")'
#: A message that breaks off: only a sender and a time (no comma after it), and the next sender where its own object should be.
TRUNCATED = r'(\{\s*"sender_name":\s*"(?:[^"\\]|\\.)*",\s*"timestamp_ms":\s*\d+)\s*,?\s*("sender_name")'
#: A string, or a comma before a closing bracket: strings are matched first, so that commas inside them stay.
TRAILING_COMMA = r'("(?:[^"\\]|\\.)*+")|,(?=\s*[}\]])'

_OPTIONS = {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE"}


def parse(raw):
    """The export as a struct, or null where the text is no JSON object.

    ``from_json`` gives a struct of nulls for broken text, so a corrupt-record field tells the two apart.
    """
    schema = EXPORT.add("_corrupt_record", "string") if "_corrupt_record" not in EXPORT.names else EXPORT
    parsed = F.from_json(col(raw), schema, _OPTIONS | {"columnNameOfCorruptRecord": "_corrupt_record"})
    good = parsed.isNotNull() & parsed["_corrupt_record"].isNull() & col(raw).rlike(r"\A[\s\x{FEFF}]*\{")
    return F.when(good, parsed)


def repaired(raw):
    """A struct of text and fixes: the repairs in order, each on what the one before made."""
    t0 = col(raw)
    t1 = F.regexp_replace(t0, TRUNCATED, "$1, \"content\": \"\"}, {$2")
    t2 = F.regexp_replace(t1, MISSING_COMMA, "$1,\n$2")
    t3 = F.regexp_replace(t2, TRAILING_COMMA, "$1")
    fixes = F.filter(
        F.array(
            F.when(t1 != t0, "closed a truncated message"), F.when(t2 != t1, "added a missing comma before sender_name"),
            F.when(t3 != t2, "removed trailing commas")),
        lambda f: f.isNotNull())
    return F.struct(t3.alias("text"), fixes.alias("fixes"))


def load(files, raw="raw"):
    """files plus ``data`` (the parsed export, null if it can't be parsed) and ``fixes`` (what was repaired)."""
    first = files.withColumn("_first", parse(F.regexp_replace(col(raw), r"\A\x{FEFF}", "")))
    second = first.withColumn("_fixed", F.when(F.col("_first").isNull(), repaired(F.regexp_replace(col(raw), r"\A\x{FEFF}", ""))))
    both = second.withColumn("_second", F.when(F.col("_first").isNull(), parse(F.col("_fixed.text"))))
    none = F.array().cast("array<string>")
    return (both.withColumn("data", F.coalesce("_first", "_second"))
            .withColumn("fixes", F.when(F.col("_second").isNotNull(), F.col("_fixed.fixes")).otherwise(none))
            .drop("_first", "_fixed", "_second"))
