"""Text functions as column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadmill.functions.references import unescape_sql

# Which characters mark a double-encoded text, and the replacement rules of a slug.
MOJIBAKE_MARKS = "[ÄÅÃ]"
MOJIBAKE_MARKS_EXTENDED = "[ÄÅÃâÂð]"
BEYOND_LATIN1 = r"[^\x00-\xFF]"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
UNSAFE_IN_SLUG = r'[\\/:*?"<>|]'
SLUG_BLANKS = r"[\t\r\f\x0B ]+"
SLUG_LENGTH = 140
PREVIEW_LENGTH = 100
#: What Python's str.split() takes for white space.
PYTHON_BLANKS = r"(?U)[\s\x1c-\x1f]+"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_str(x) -> Column:
    """The value as a string; null becomes empty."""
    return F.coalesce(col(x).cast("string"), F.lit(""))


def let(expr, body) -> Column:
    """body(x) for x = expr, which is evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(expr), body), 1)


def fix_mojibake(x, mode: str = "compat") -> Column:
    """UTF-8 text that was read as Latin-1 repaired as a whole, or unchanged if that can't be.

    ``compat`` looks for the marks of Latin letters only; ``extended`` also for those of punctuation and emoji.
    """
    if mode not in ("compat", "extended"):
        raise ValueError(f"unknown mode {mode!r}")
    marks = MOJIBAKE_MARKS if mode == "compat" else MOJIBAKE_MARKS_EXTENDED

    def fixed(t):
        # encode() would raise at characters beyond Latin-1, so they are replaced in the branch that isn't taken too
        raw = F.encode(F.regexp_replace(t, BEYOND_LATIN1, "?"), "ISO-8859-1")
        return F.when(t.rlike(marks) & ~t.rlike(BEYOND_LATIN1), F.coalesce(F.try_validate_utf8(raw.cast("string")), t)).otherwise(t)

    return let(col(x), fixed)


def unescape_html(x) -> Column:
    """Named and numeric HTML references resolved, inside the JVM."""
    return F.element_at(F.call_function("transform", F.array(col(x)), F.expr(f"x -> {unescape_sql()}")), 1)


def strip_controls(x) -> Column:
    return F.regexp_replace(col(x), CONTROLS, "")


def clean_whitespace(x) -> Column:
    """Line ends to LF, runs of tabs and blanks to one, no blanks at line ends, two empty lines at most, no LF at the ends."""
    t = F.regexp_replace(col(x), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[\t ]+", " ")
    t = F.regexp_replace(t, r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")
    t = F.regexp_replace(t, r"\n{4,}", "\n\n\n")
    return F.regexp_replace(t, r"\A\n+|\n+\z", "")


def clean_text(x, mode: str = "compat", entities: bool = True) -> Column:
    """The whole cleaning chain, in its fixed order. entities=False leaves HTML references as they are."""
    t = fix_mojibake(safe_str(x), mode)
    t = unescape_html(t) if entities else t
    return clean_whitespace(strip_controls(t))


def slugify(x) -> Column:
    """A file name of a title: lower case, unsafe characters to hyphens, blanks to single underscores."""
    t = F.lower(F.regexp_replace(safe_str(x), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""))
    t = F.regexp_replace(t, UNSAFE_IN_SLUG, "-")
    t = F.regexp_replace(F.regexp_replace(t, SLUG_BLANKS, "_"), "_+", "_")
    return F.substring(t, 1, SLUG_LENGTH)


def uri_filename(x) -> Column:
    """What follows the last slash, up to a question mark."""
    return F.substring_index(F.substring_index(safe_str(x), "/", -1), "?", 1)


def word_count(x) -> Column:
    return F.size(F.filter(F.split(safe_str(x), PYTHON_BLANKS), lambda w: w != ""))


def is_blank(x) -> Column:
    return ~safe_str(x).rlike(r"(?U)[^\s\x1c-\x1f]")


def preview(x, length: int = PREVIEW_LENGTH) -> Column:
    """The first characters on one line, with an ellipsis if there are more."""
    t = safe_str(x)
    return F.translate(F.concat(F.substring(t, 1, length), F.when(F.length(t) > length, "...").otherwise("")), "\n", " ")


def iso_seconds(ms) -> Column:
    """Epoch milliseconds as ISO date and time of the session's time zone, floored to seconds."""
    return F.date_format(F.timestamp_millis(col(ms).cast("long")), "yyyy-MM-dd'T'HH:mm:ss")


def escape_html(x) -> Column:
    t = safe_str(x)
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(c), F.lit(name))
    return t


def html_lines(x) -> Column:
    """Escaped text with line feeds as breaks."""
    return F.replace(escape_html(x), F.lit("\n"), F.lit("<br>"))


#: Bodies of the SQL functions that ``register`` offers; a test holds them against the expressions above.
SQL_FUNCTIONS = {
    "tm_slug": ("STRING", r"""substring(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(x, ''), r'(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z', '')), r'[\\/:*?"<>|]', '-'), r'[\t\r\f\x0B ]+', '_'), '_+', '_'), 1, 140)"""),
    "tm_words": ("INT", r"""size(filter(split(coalesce(x, ''), r'(?U)[\s\x1c-\x1f]+'), w -> w <> ''))"""),
    "tm_preview": ("STRING", r"""translate(concat(substring(coalesce(x, ''), 1, 100), CASE WHEN length(coalesce(x, '')) > 100 THEN '...' ELSE '' END), '\n', ' ')"""),
    "tm_filename": ("STRING", "substring_index(substring_index(coalesce(x, ''), '/', -1), '?', 1)"),
    "tm_unescape": ("STRING", unescape_sql()),
}


def register(spark) -> None:
    """Makes the text functions of SQL_FUNCTIONS callable from the session's SQL."""
    for name, (kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
