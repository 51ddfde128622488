import re
from collections import Counter

import pytest

from threadmill.llm import op1_quality_rules as op


def brute(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count = Counter(wins)
    covered = {j for i, x in enumerate(wins) if count[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e a b c d e", "a a a a a a a a a a a a", "x y z", "p q r s t u v. " * 30,
    "one two three four five six seven eight nine ten eleven twelve.", "l1\nl1\n\n\nl2\n l1\r\nl1\r\n", "# $ % <b> & | * " * 40,
    "É ñ 漢字 😀 " * 20, "w" * 200_000, " ".join(f"w{i}" for i in range(30_000)), "a b c d e f " + " ".join(f"w{i}" for i in range(50)) + " a b c d e f",
]


def test_base_counts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in op.of(df).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute(TEXTS[r.doc_id]), r.doc_id
    assert op.of(df.limit(0)).count() == 0


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op.of(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])


@pytest.mark.parametrize("line,fails", [
    ("A plain sentence that ends well.", False), ("", False), ("Home | News | Sport | Contact | About", True),
    ("We use cookies to improve this site.", True), ("WOW!! BUY!! NOW!! HERE!!", True), ("a*** b### c$$$ d%%%", True),
    ("Licensed under a free licence, version 2.0.", False), ("Heading without a stop", False),
])
def test_line_rules(spark, line, fails):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(line,)], "x string")
    assert df.select(op.line_fails(F.col("x")).alias("f")).first().f is fails


def test_verdict_and_clashing_names(spark):
    good = "This is a line of a good document with words enough. " * 1 + "\nAnother line follows it here and says more things."
    bad = "Home | News | Sport | Contact | About us | Legal | More\n" * 1 + "Shop | Cart | Deals | Offers | Gifts | Books | Music\nshort end."
    df = spark.createDataFrame([(1, good, 7), (2, bad, 7), (1, good, 7)], "doc_id long, text string, kept int")
    rows = op.clean(df).collect()
    assert [(r.doc_id, r.kept) for r in rows] == [(1, True), (2, False), (1, True)]
    assert rows[0].cleaned == good and rows[1].cleaned == "short end."


@pytest.mark.parametrize("line,fails", [
    ("Alle Rechte vorbehalten.", True), ("Wir verwenden Cookies, um die Seite zu verbessern.", True), ("Tous droits réservés", True), ("Lire la suite...", True), ("POLÍTICA DE PRIVACIDAD", True),
    ("Todos los derechos reservados", True), ("Wir lesen viele gute Texte.", False), ("Une suite de mots simples.", False), ("Bitte nicht vorbehaltlos.", False), ("Read more " + "x" * 400, False), ("They blogin to", False),
])
def test_phrases_of_four_languages(spark, line, fails):
    import duckdb
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(line,)], "x string").select(op.line_fails(F.col("x")).alias("f")).first().f is fails
    found = duckdb.execute("SELECT regexp_matches(?, ?)", [line, op.BOILERPLATE]).fetchone()[0]
    assert (found and len(line) < op.BOILERPLATE_CHARS) is fails


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "a text", "x", 2, 3)], "doc_id long, text string, _text string, _words int, _full int")
    r = op.clean(df).first()
    assert (r._text, r._words, r._full, r.n_words) == ("x", 2, 3, 2)
