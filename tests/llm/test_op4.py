import random
import re
from collections import defaultdict

import regex

from threadmill.llm import op4_decontamination as op


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def brute(docs, bench):
    """Verbatim passages: the share of an item's five-word windows that a text has."""
    bad = set()
    items = [({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}) for w in map(words, bench) if w]
    for d, t in docs:
        w = words(t)
        own = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
        if any(2 * len(own & x) >= len(x) for x in items):
            bad.add(d)
    return bad


def test_whole_table(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs, bench = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "benchmark"))
        got = op.of(docs, bench).collect()
        want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
        assert {r.doc_id for r in got if r.contaminated} == want and want
        assert len(got) == docs.count()


ITEM = "A farmer named Ada sells 12 apples for 3 dollars each and then buys 5 kg of flour; how many dollars does Ada have after selling 12 apples?"


def test_reparameterised(spark):
    bench = spark.createDataFrame([(7, ITEM), (8, ITEM), (9, "two words"), (10, None)], "item_id long, text string")
    rows = [
        (1, "Try this. " + ITEM + " Good luck with it."),
        (2, ITEM.replace("Ada", "Bob").replace("12", "40").replace("3 dollars", "9 euros").replace("5 kg", "7 lb") + " More."),
        (3, ITEM.replace("named Ada", "named Bob").replace("12 apples for", "40 apples for")),  # most of it verbatim
        (15, ITEM.replace("Ada", "Bob").replace("12 apples for", "40 apples for").replace("12 apples?", "41 apples?").replace("3 dollars", "9 euros").replace("5 kg", "7 lb")),  # 12 is 40 here and 41 there
        (14, ITEM + " Later on, after selling 99 apples for 7 dollars each, Eve buys nothing."),  # verbatim beside other values
        (4, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"), (5, None), (6, ""), (6, ""), (None, ITEM), (11, "Two words"), (12, "two words more"),
        (13, "A plain text about nothing of the kind, with words enough to make windows."),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    got = [(r.doc_id, r.contaminated, r.item_id) for r in op.of(docs, bench).collect()]
    assert sorted((d for d, c, _ in got if c), key=str) == sorted([1, 2, 3, 11, 14, None], key=str)
    assert len(got) == len(rows) and {i for d, c, i in got if d == 1} == {7}
    kept = op.decontaminate(docs, bench).where("not contaminated")
    assert kept.count() == len(rows) - 6
    assert op.of(docs.limit(0), bench).count() == 0
    assert op.of(docs, bench.limit(0)).where("contaminated").count() == 0


def test_shuffled_join_is_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    a = sorted(map(tuple, op.of(docs, bench).collect()))
    monkeypatch.setattr(op, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, op.of(docs, bench).collect())) == a


def caught(spark, item, texts):
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.contaminated for r in op.of(docs, bench).orderBy("doc_id").collect()]


def test_each_run_is_judged_alone(spark):
    twice = "Then we see that Ann buys 3 red pens and Bob buys 5 red pens and Cy buys 9 red pens today"
    renamed = twice.replace("Ann", "Dora").replace("Bob", "Eve").replace("Cy", "Finn").replace("3", "4").replace("5", "6").replace("9", "8")
    assert caught(spark, twice, [renamed, renamed.replace("Eve buys", "Eve then buys"), renamed.replace("8", "6")]) == [True, True, True]
    a = ITEM.replace("Ada", "Bob").replace("12", "40").replace("3 dollars", "9 euros")
    b = ITEM.replace("Ada", "Eve").replace("12", "70").replace("3 dollars", "8 pounds")
    far = " The end came and after selling 99 apples for 7 dollars each, nobody buys."
    assert caught(spark, ITEM, [a + " Next. " + b, a.replace("9 euros", "40 euros"), a + " and so on" * 30 + far]) == [True, True, True]
    wrong = ITEM.replace("Ada", "Bob").replace("12 apples for", "40 apples for").replace("12 apples?", "41 apples?").replace("3 dollars", "9 euros").replace("5 kg", "7 lb")
    assert caught(spark, ITEM, [wrong + " Next. " + wrong, "Nothing of it."]) == [False, False]


def test_few_literals_and_short_items(spark):
    for item in ("Solve 12 * 34 + 56 - 7", "Add 1 2 3 4 5 6 7 8"):
        assert caught(spark, item, ["Now: " + item + " = what", item.replace("2", "9"), "Solve it, or add 1 2 3"]) == [True, False, False]
    assert caught(spark, "what is entropy", ["Tell me, what is entropy in 12 words?", "tell me what is entropy", "What entropy is"]) == [True, True, False]
    assert caught(spark, "solve 12 34", ["please solve 12 34 now", "solve 5 6", "please solve 5 6 now"]) == [True, True, False]
    assert caught(spark, "什么是热力学的熵", ["请问什么是热力学的熵呢", "请问什么是爱"]) == [True, False]
    ends = "The answers to the following are 1 2 3 4 5 6 7 8"  # half of its windows have few literals; the renamed copy counts by the others
    assert caught(spark, ends, ["So: " + ends, "The answers to the following are 9 8 7 6 5 4 3 1"]) == [True, True]


# Templates, slots and runs once more, by loops.

TOKEN, UNSPACED = (op._TOKEN, op._UNSPACED.replace("\\x{20000}-\\x{3FFFF}", "\\U00020000-\\U0003FFFF"))


def template(text):
    text = regex.sub(f"({op._NAME})", "\x01\\1", text or "")
    text = regex.sub(f"([[{UNSPACED}]&&\\p{{L}}]\\p{{M}}*)", r" \1 ", text, flags=regex.V1) if regex.search(f"[{UNSPACED}]", text) else text
    raw, tpl = regex.findall(TOKEN, text), []
    for i, w in enumerate(raw):
        if regex.match(r"\p{N}", w):
            tpl.append("<number>")
        elif w.lower() in op.UNITS and i and regex.match(r"[\p{N}$€£]", raw[i - 1]):
            tpl.append("<unit>")
        else:
            tpl.append("<name>" if w[0] == "\x01" else w.lower())
    return raw, tpl


def windows(text, lengths=None):
    """(at, key, slots or None, exact) of each window."""
    raw, tpl = template(text)
    n, out = len(raw), []
    slotted = any(t.startswith("<") for t in tpl)

    def one(i, k):
        own = tpl[i:i + k]
        if not slotted:
            return i, ("t", *own), None, False
        if sum(not t.startswith("<") for t in own) >= op.LITERALS:
            return i, ("t", *own), tuple(r for r, t in zip(raw[i:], own) if t.startswith("<")), False
        return i, ("v", *(w.lower().replace("\x01", "") for w in raw[i:i + k])), None, True

    def of(k):
        return [one(i, k) for i in range(n - k + 1)] if (n >= k if k >= op.LITERALS else n == k) else []

    out = of(op.WINDOW)
    for k in range(1, op.WINDOW) if lengths is None else lengths:
        out = of(k) if lengths is None and n == k else out if lengths is None else out + of(k)
    if (lengths is None or lengths) and 0 < n < op.WINDOW and slotted and 0 < sum(not t.startswith("<") for t in tpl) < op.LITERALS:
        out = out + [(0, ("t", *tpl), tuple(r for r, t in zip(raw, tpl) if t.startswith("<")), False)]
    return n, out


def cover(matches, n, sizes):
    """Per cent of the item's windows in one run of matches (at, item_at, exact, slots, item slots)."""
    values = defaultdict(set)
    for *_, slots, item in matches:
        for was, now in zip(item or (), slots or ()):
            values[was].add(now)
    odd = any(len(v) > 1 for v in values.values())
    counted = [m for m in matches if not odd or m[2] or m[3] == m[4]]
    every, rich = {m[1] for m in counted}, {m[1] for m in counted if not m[2]}
    return max(100 * len(every) / sizes[0], 100 * len(rich) / sizes[1] if sizes[1] else 0)


def runs_of(matches, n):
    yield matches
    diagonals = defaultdict(list)
    for m in matches:
        diagonals[m[0] - m[1]].append(m)
    yield from diagonals.values()
    best = {}
    for m in matches:
        rank = (-len(diagonals[m[0] - m[1]]), m[0] - m[1], m[1])
        best[m[0]] = min(best.get(m[0], (rank, m)), (rank, m), key=lambda x: x[0])
    run = []
    for at in sorted(best):
        m = best[at][1]
        if run and (m[1] <= run[-1][1] or at - run[-1][0] > n):
            yield run
            run = []
        run.append(m)
    if run:
        yield run


def brute_templates(docs, bench):
    items = [(i, *windows(t)) for i, t in bench]
    lengths = sorted({n for _, n, w in items if w and n < op.WINDOW})
    bad = {}
    for d, t in docs:
        by_key = defaultdict(list)
        for at, key, slots, _ in windows(t, lengths)[1]:
            by_key[key].append((at, slots))
        for i, n, own in items:
            matches = [(at, item_at, exact, slots, item_slots) for item_at, key, item_slots, exact in own for at, slots in by_key.get(key, ())]
            if not matches:
                continue
            rich = {x[0] for x in own if not x[3]}
            best = max(cover(r, n, (len({x[0] for x in own}), len(rich))) for r in runs_of(matches, n))
            if best >= op.COVER and (d not in bad or (-best, i) < bad[d]):
                bad[d] = (-best, i)
    return {d: (i, round(-c, 4)) for d, (c, i) in bad.items()}


def test_templates_against_loops(spark):
    rng = random.Random(11)
    words = "the a farmer sells buys apples red pens then how many are left of flour after each day".split()

    def item():
        out = []
        for _ in range(rng.choice((2, 3, 4, 6, 9, 14, 25))):
            out.append(rng.choice([*words, *words, str(rng.randrange(1, 30)), rng.choice(("Ann", "Bob", "Cy")), f"{rng.randrange(1, 9)} kg"]))
        return " ".join(out)

    def copy(t):
        names, numbers = dict(zip(("Ann", "Bob", "Cy"), rng.sample(("Ann", "Eve", "Finn", "Gus"), 3), strict=True)), {}
        out = regex.sub(r"\d+", lambda m: numbers.setdefault(m[0], str(rng.randrange(1, 99))), t)
        out = regex.sub("Ann|Bob|Cy", lambda m: names[m[0]], out).split()
        for _ in range(rng.choice((0, 0, 1, 3))):
            out.insert(rng.randrange(len(out) + 1), rng.choice(words))
        return " ".join(out)

    bench = [(k, item()) for k in range(40)] + [(40, "什么是热力学的熵"), (41, "what is 12"), (42, None), (43, "")]
    docs = []
    for k in range(150):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(2)]
        parts[1:1] = [rng.choice((copy, str))(rng.choice(bench[:42])[1]) for _ in range(rng.choice((0, 1, 1, 2)))]
        docs.append((k, " so ".join(parts)))
    docs += [(500, "请问什么是热力学的熵呢 12 kg"), (501, None), (502, "")]
    got = op.of(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    want = brute_templates(docs, bench)
    assert {r.doc_id: (r.item_id, r.cover) for r in got if r.contaminated} == want and 20 < len(want) < 150


def test_documents_against_loops(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_templates([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert {r.doc_id: (r.item_id, r.cover) for r in op.of(docs, bench).where("contaminated").collect()} == want and want
