"""Column expressions against an independent statement of each rule in Python."""

import html
import random
import re
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from threadmill.functions import attachments, hashing, text
from threadmill.functions.references import CHUNK

ALPHABET = list("ab &;<>'\"\t\n\r\x00\x07\x0b\x0c\x1c\x7f\x85\xa0ÄÅÃéł😀/\\:*?|_") + ["&amp;", "&#65;", "\r\n", "\n\n\n", "Ã©", "Ä‡", "  ", "x/y.jpg?z"]


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(7)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(1500)]
    return [*out, "", None, "plain", " ", "a  \nb", "😀" * 150, "naïve".encode().decode("latin-1"), "Å".encode().decode("latin-1"), "x" * 300]


def column(spark, strings, f):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string")
    return [r.x for r in df.select("i", f("s").alias("x")).orderBy("i").collect()]


def mojibake(s):
    if not re.search("[ÄÅÃ]", s):
        return s
    try:
        return s.encode("latin-1").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return s


def whitespace(s):
    s = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", s).replace("\r\n", "\n").replace("\r", "\n")
    lines = [line.rstrip() for line in re.sub("[\t ]+", " ", s).split("\n")]
    return re.sub("\n{4,}", "\n\n\n", "\n".join(lines)).strip("\n")


def slug(s):
    s = s.strip().lower()
    for c in '\\/:*?"<>|':
        s = s.replace(c, "-")
    return re.sub("_+", "_", re.sub("[\t\r\f\v ]+", "_", s))[:140]


RULES = {
    "clean": (text.clean_text, lambda s: whitespace(html.unescape(mojibake(s)))),
    "mojibake": (lambda c: text.fix_mojibake(text.safe_str(c)), mojibake),
    "slug": (text.slugify, slug),
    "words": (text.word_count, lambda s: len(s.split())),
    "blank": (text.is_blank, lambda s: not s.strip()),
    "filename": (text.uri_filename, lambda s: s.split("/")[-1].split("?")[0]),
    "preview": (text.preview, lambda s: (s[:100] + ("..." if len(s) > 100 else "")).replace("\n", " ")),
    "escape": (text.escape_html, html.escape),
}


@pytest.mark.parametrize("name", sorted(RULES))
def test_rule(spark, strings, name):
    f, rule = RULES[name]
    got = column(spark, strings, f)
    for s, g in zip(strings, got, strict=True):
        assert g == rule(s or ""), repr(s)


def test_extended_mojibake(spark):
    emoji = "😀 ’".encode().decode("latin-1")
    assert column(spark, [emoji], text.fix_mojibake) == [emoji]
    assert column(spark, [emoji], lambda c: text.fix_mojibake(c, "extended")) == ["😀 ’"]
    with pytest.raises(ValueError):
        text.fix_mojibake("s", "odd")


def test_sql_functions(spark, strings):
    text.register(spark)
    spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string").createOrReplaceTempView("strings")
    for name, f in (("tm_slug", text.slugify), ("tm_words", text.word_count), ("tm_preview", text.preview), ("tm_filename", text.uri_filename)):
        assert [r.x for r in spark.sql(f"SELECT {name}(s) AS x FROM strings ORDER BY i").collect()] == column(spark, strings, f)
    assert spark.sql("SELECT tm_unescape('a &lt; b') AS x").first().x == "a < b"


def test_times_and_hashes(spark):
    df = spark.createDataFrame([(1702800000999, 0b1111, 0), (-1, -1, 0)], "ms long, a long, b long")
    rows = df.select(text.iso_seconds("ms").alias("t"), hashing.hamming64("a", "b").alias("d"), hashing.hash_hex("a").alias("h")).collect()
    assert [tuple(r) for r in rows] == [("2023-12-17T08:00:00", 4, "000000000000000f"), ("1969-12-31T23:59:59", 64, "f" * 16)]
    names = spark.createDataFrame([(["Bob", "ann", ""],), ([],)], "p array<string>")
    assert [r.x for r in names.select(hashing.participant_signature("p").alias("x")).collect()] == ["ann\x1fbob", ""]


def test_no_reactions(spark):
    df = spark.createDataFrame([(None,), ([],)], "r array<struct<reaction:string,actor:string>>")
    assert [r.x for r in df.select(attachments.reaction_summary("r").alias("x")).collect()] == ["", ""]
    assert df.select(F.lit(1)).count() == 2


def test_references_against_python(spark):
    rng = random.Random(11)
    bits = ["&", "#", "x", "X", ";", "a", "lt", "amp", "not", "in", "3", "0", "9", "F", " ", "\n", "<", "é", "😀", "28", "&#", "&#x", "&lt", "&gt;", "copy", "=", "|", "\\", "'", "$1"]
    mixed = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(5000)]
    names = [f for k in html5 for f in ("&" + k, f"a &{k.rstrip(';')}x &{k}", f"&{k[:-2]};")]
    numbers = [*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFEFF, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFF, 0x10FFFD, 0x10FFFF, 0x110000, 9999999, 10**8, 1 << 32, 1 << 64]
    numbers = [f for n in numbers for f in (f"&#{n};b", f"&#{n}b", f"&#x{n:x};", f"&#X{n:X}g", f"&#00000000{n};", f"&#x00000000{n:x}")]
    odd = ["&#" + "9" * 4000 + ";", "&#;", "&#x;", "&amp;amp;", "&notit;", "&" + "a" * 40 + ";", "&lt=3c|gt;", "&amp\n;", "&#٣;", "&#65279;"]
    # long texts are cut: references of five kinds and lengths around the cuts
    long = ["z" * k + "&lt;&#38;lt;&amp&notin;&" * (CHUNK // 8) for k in range(24)] + ["".join(rng.choice(bits) for _ in range(CHUNK)), "x" * 3 * CHUNK, "😀" * CHUNK + "&gt;", "&" * (CHUNK + 1), "\n" * (CHUNK - 1) + "&lt;" + "\n" * CHUNK]
    texts = names + numbers + odd + mixed + long
    for s, got in zip(texts, column(spark, texts, text.unescape_html), strict=True):
        assert got == html.unescape(s), repr(s[:100])
    # Python raises an error at more than 4300 digits
    assert column(spark, ["&#" + "1" * 5000 + ";x", None], text.unescape_html) == ["\ufffdx", None]


def test_texts_stay_in_the_jvm(spark):
    """Python holds a batch of rows at a time, however long they are."""
    text.register(spark)
    df = spark.createDataFrame([("a &lt; b",)], "s string")
    for c in (text.unescape_html("s"), text.clean_text("s"), F.call_function("tm_unescape", F.col("s"))):
        plan = df.select(c.alias("x"))._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan
        assert df.select(c.alias("x")).first().x == "a < b"
