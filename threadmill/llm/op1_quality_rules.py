"""Quality rules, line first: each line passes punctuation, navigation and boilerplate rules or goes, and a document that
loses too much of its text goes whole. Built-in expressions only.

Rules of a line (a blank line always stays):

* punctuation: more than SYMBOL_SHARE of its characters are of ``#*$%&|<>``, or it has a doubled or mixed ``!``/``?``
  for every second word or more, or it has over LONG_LINE words and no sentence punctuation at all;
* navigation: NAV_BARS or more bars or arrows that separate items;
* boilerplate: a cookie, script, rights, newsletter or login phrase, in a line of at most BOILERPLATE_WORDS words and
  fewer than BOILERPLATE_CHARS characters: longer lines are prose that mentions such a phrase. The phrases are English, German, French
  and Spanish.

Equal five-word windows are found by 64-bit hashes within one text; there the chance of a false pair is below 1e-10.

Edge cases: null and empty texts have no words, so base_failed; texts of one very long line or word are handled whole;
ties and equal rows give equal results; an empty table gives no rows; further columns, whatever their names, pass
through ``clean``, and its outputs replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill.llm.common import SPACE, free_name, let, table, word_array

NAME = "op1_quality_rules"
SYMBOLS = "#*$%&|<>"
#: Shares in per cent.
SYMBOL_SHARE, MOST_LOST = 8, 50
LONG_LINE, NAV_BARS, BOILERPLATE_WORDS, BOILERPLATE_CHARS = 60, 3, 30, 400
WINDOW = 5
#: Phrases in English, German, French and Spanish, at the beginning of a word. Both Java and RE2 read them alike.
BOILERPLATE = (
    "(?i)(^|[^a-z])(accept (all )?cookies|use[sd]? cookies|enable javascript|javascript is (disabled|required)|all rights reserved|terms of (use|service)"
    "|privacy policy|subscribe to our|sign up for|log ?in to|click here|read more|lorem ipsum|share (this|on) |back to top"
    "|(alle )?cookies (akzeptieren|zulassen)|verwende[nt] cookies|javascript aktivieren|alle rechte vorbehalten|nutzungsbedingungen|datenschutzerkl|newsletter abonnieren|hier klicken|mehr lesen|weiterlesen|nach oben"
    "|accepter (tous )?les cookies|utilise(ns|z)? des cookies|activer javascript|tous droits r.serv|conditions d.utilisation|politique de confidentialit|abonnez-vous|cliquez ici|lire la suite|haut de page"
    "|aceptar (todas las )?cookies|utiliza(mos)? cookies|activar javascript|todos los derechos reservados|condiciones de uso|pol.tica de privacidad|suscr.bete|haz clic aqu|leer m.s|volver arriba)"
)


def _removed(text, chars):
    """text without the given single characters."""
    for c in chars:
        text = F.replace(text, F.lit(c))
    return text


def line_fails(line):
    """True for a line that a rule removes."""
    words = F.size(F.split(F.trim(line), f"[{SPACE}]+"))
    symbols = F.length(line) - F.length(_removed(line, SYMBOLS))
    noisy = line.rlike(f"[{SYMBOLS}]") & (100 * symbols > SYMBOL_SHARE * F.length(line))
    shouting = line.rlike("[!?]{2}") & (2 * F.regexp_count(line, F.lit("[!?]{2,}")) >= words)
    endless = (F.length(line) > 2 * LONG_LINE) & ~line.rlike("[.!?;:。！？…]") & (words > LONG_LINE)
    bars = line.rlike("[|»›→]") & (F.regexp_count(line, F.lit(f"(?:^|[{SPACE}])[|»›→](?=[{SPACE}]|$)")) >= NAV_BARS)
    boiler = (F.length(line) < BOILERPLATE_CHARS) & line.rlike(BOILERPLATE) & (words <= BOILERPLATE_WORDS)
    return line.rlike(f"[^{SPACE}]") & (noisy | shouting | endless | bars | boiler)


def repeated_words(hashes):
    """Words within windows that occur twice or more, from the windows' hashes in order."""
    at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    places = let(at, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
    steps = let(places, lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), x - F.coalesce(F.get(p, j - 1), x - WINDOW))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered)


def clean(df, text="text"):
    """df with the base counts, base_failed, lost_chars, kept and cleaned (the text of the lines that stay)."""
    t, w, lines, hashes, judged, full = (free_name(df, x) for x in ("text", "words", "lines", "hashes", "judged", "full"))
    df = df.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumns({w: word_array(F.col(t)), lines: F.split(t, "\n")})
    n = F.size(w)
    df = df.withColumns({
        "n_words": n.cast("long"),
        hashes: F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col(w), i, WINDOW)))).otherwise(F.array().cast("array<bigint>")),
        judged: F.transform(lines, lambda x: F.struct(x.alias("line"), line_fails(x).alias("fails"))),
        full: F.filter(lines, lambda x: x.rlike(f"[^{SPACE}]")),
    })
    lost = F.aggregate(judged, F.lit(0).cast("long"), lambda a, x: a + F.when(x["fails"], F.length(x["line"])).otherwise(0))
    df = df.withColumns({
        "word_chars": F.length(_removed(F.col(t), " \t\n\x0b\x0c\r")).cast("long"),
        "n_symbols": F.when(F.col(t).rlike(f"[{SYMBOLS}]"), F.length(t) - F.length(_removed(F.col(t), SYMBOLS))).otherwise(0).cast("long"),
        "n_dup_lines": (F.size(full) - F.size(F.array_distinct(full))).cast("long"),
        "n_repeat_words": repeated_words(F.col(hashes)),
        "lost_chars": lost,
    })
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MOST_LOST * F.length(t)))
    cleaned = F.array_join(F.transform(F.filter(judged, lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
    return df.withColumn("cleaned", cleaned).drop(t, w, lines, hashes, judged, full)


def query(spark, sf_dir):
    return of(table(spark, sf_dir, "documents"))


def of(docs):
    return clean(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


_SPACES = r"[\x20\x09-\x0D]+"
#: The same counts and rules in DuckDB: windows as joined words, bars as words of their own.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_SPACES}'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS l FROM d),
     v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS c
           FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
     r AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS place FROM v WHERE c > 1) GROUP BY doc_id),
     lines AS (SELECT doc_id, unnest(l) AS line FROM w),
     facts AS (SELECT doc_id, line, regexp_split_to_array(trim(line), '{_SPACES}') AS lw, length(line) - length(regexp_replace(line, '[{SYMBOLS}]', '', 'g')) AS symbols FROM lines),
     lost AS (SELECT doc_id, CAST(sum(CASE WHEN regexp_matches(line, '[^\\x20\\x09-\\x0D]') AND (
                 (symbols > 0 AND 100 * symbols > {SYMBOL_SHARE} * length(line))
                 OR (regexp_matches(line, '[!?]{{2}}') AND 2 * len(regexp_extract_all(line, '[!?]{{2,}}')) >= len(lw))
                 OR (length(line) > {2 * LONG_LINE} AND NOT regexp_matches(line, '[.!?;:。！？…]') AND len(lw) > {LONG_LINE})
                 OR len(list_filter(lw, lambda x: x IN ('|', '»', '›', '→'))) >= {NAV_BARS}
                 OR (length(line) < 400 AND regexp_matches(line, '{BOILERPLATE}') AND len(lw) <= {BOILERPLATE_WORDS}))
               THEN length(line) ELSE 0 END) AS BIGINT) AS lost_chars FROM facts GROUP BY doc_id),
     b AS (SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                  CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
                  CAST(len(list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS BIGINT) AS n_dup_lines,
                  coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_chars <= {MOST_LOST} * length(t) AS kept, lost_chars
FROM b JOIN lost USING (doc_id)
"""
