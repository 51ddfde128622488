"""Near duplicates by BagMinHash: weighted-Jaccard signatures, bands, verified multiset overlap, connected classes.

A text is the multiset of its windows of five words (all its words, if fewer). Weights are discretised to integers and
these to dyadic levels [0,1), [1,2), [2,4), [4,8) ...; each level of each window carries a Poisson process, seeded by both,
whose rate is the level's width times the number of components. A point has a time, a component and a height within its
level, and counts if the height is below the window's weight. A component is the earliest time that counts. The earliest
point of the union of two bags lies in both with probability the sum of minima over the sum of maxima, so the share of
equal components is unbiased for weighted Jaccard. Points are made up to a time at which all components are met as a rule;
texts that lack one go on to twice that time, so the signature never depends on the limit.

BANDS bands of ROWS rows miss a pair at the threshold with probability 3.2e-6. Equal texts are one node. Candidates:

1. in each bucket the node that meets most others over all its buckets (the original of edited copies, as a rule) is paired
   with all others of the bucket; verified links give classes;
2. buckets of three or more that still hold several classes are dealt in pairs of blocks of at most SCAN nodes or so, with
   their signatures only (a tenth of a kilobyte each); the nodes whose signature is near one of another class go on;
3. these are dealt again, in pairs of blocks of at most BLOCK nodes with their bags. There each pair of different classes
   is compared, in the first band that it shares only, by signatures and then by bags; just the links that join classes
   leave the task.

So no candidate is capped or dropped, no pair within a class is enumerated, a task holds two blocks at most, and what is
emitted is in proportion to the nodes. Step 2 is what a bucket of n texts that share a passage and little else costs: n / SCAN
times its signatures are shuffled, no bags. A pair whose signatures share less than LEAST_EQUAL of M components isn't verified:
at the threshold that happens with probability 3e-5. A pair is a link if the exact multiset overlap is THRESHOLD or
more; a class is what links connect. Everything stays distributed; steps are cut by checkpoints in the shared folder.

Edge cases: a null text is empty; empty texts are copies of each other and near nothing else; null ids stay rows and get the
least id of their class; equal rows (ids too) stay rows; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm.common import free_name, released, saved, small_batches, table

NAME = "op6_minhash"
SHINGLE, THRESHOLD = 5, (4, 5)
BANDS, ROWS = 24, 4
M = BANDS * ROWS
#: Nodes of a block, about: with signatures, and with bags.
SCAN, BLOCK = 8192, 1024
#: Components (of M) that the signatures of a pair share that is verified.
LEAST_EQUAL = 60
#: Word hashes that a worker keeps.
WORDS_KEPT = 200_000
_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_words: dict[str, int] = {}


def _mix(x):
    """A bijection of 64-bit integers that looks random."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """64-bit hashes of the windows of a text, in order."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > WORDS_KEPT:
        _words.clear()
    try:
        ids = [_words[w] for w in words]
    except KeyError:
        for w in {w for w in words if w not in _words}:
            _words[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        ids = [_words[w] for w in words]
    h = np.array(ids, np.uint64)
    n = min(SHINGLE, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = _mix(out + h[k:len(h) - n + 1 + k] + _GOLDEN)
    return out


def bag(text: str | None):
    """(windows ascending, their counts)."""
    return np.unique(shingles(text), return_counts=True)


def _processes(elements, weights, docs):
    """(seed, width, lowest height, doc, weight) of every level that each weight reaches."""
    parts, low, level = [], 0, 0
    while len(elements):
        width = max(1, low)
        seed = _mix(elements ^ _mix(np.full(1, level + 1, np.uint64) * _GOLDEN))
        parts.append((seed, np.full(len(seed), width, float), np.full(len(seed), low, np.int64), docs, weights))
        low, level = low + width, level + 1
        on = weights > low
        elements, weights, docs = elements[on], weights[on], docs[on]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def signatures(bags) -> np.ndarray:
    """Signatures (float64 times, one row a bag) of non-empty bags."""
    n = len(bags)
    out = np.full((n, M), np.inf)
    if not n:
        return out
    total = np.array([c.sum() for _, c in bags], float)
    seed, width, low, doc, weight = _processes(
        np.concatenate([e for e, _ in bags]), np.concatenate([c for _, c in bags]).astype(np.int64), np.repeat(np.arange(n), [len(e) for e, _ in bags]))
    limit, todo = (np.log(M) + 5) / total, np.ones(n, bool)
    while todo.any():
        on = todo[doc]
        _points(seed[on], width[on], low[on], doc[on], weight[on], limit, out.reshape(-1))
        todo = np.isinf(out).any(axis=1) | (out.max(axis=1) > limit)
        limit = np.where(todo, 2 * limit, limit)
    return out


def _points(seed, width, low, doc, weight, limit, flat):
    """Puts the points up to each doc's limit into flat."""
    t, k, block = np.zeros(len(seed)), 0, 1
    while len(seed):
        steps = np.arange(k + 1, k + block + 1, dtype=np.uint64)[None, :] * _GOLDEN
        r = _mix(seed[:, None] + steps)
        gap = -np.log(((r >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / (M * width[:, None])
        times = np.cumsum(np.concatenate([t[:, None], gap], axis=1), axis=1)[:, 1:]
        at, j = np.nonzero(times <= limit[doc][:, None])
        if len(at):
            place = _mix(r[at, j] ^ _MIX2)
            height = low[at] + ((place >> np.uint64(32)).astype(float) * 2.0**-32 * width[at]).astype(np.int64)
            good = height < weight[at]
            at, j, place = at[good], j[good], place[good]
            np.minimum.at(flat, doc[at] * M + ((place & np.uint64(0xFFFFFFFF)) % np.uint64(M)).astype(np.int64), times[at, j])
        on = times[:, -1] <= limit[doc]
        seed, width, low, doc, weight, t = seed[on], width[on], low[on], doc[on], weight[on], times[on, -1]
        k, block = k + block, min(64, block * 2)


def bands_of(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row and band; keys of different bands differ."""
    bits = sig.view(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN, bits.shape[:2])
    for r in range(ROWS):
        key = _mix(key ^ bits[:, :, r])
    return key.view(np.int64)


def low_bytes(sig: np.ndarray) -> np.ndarray:
    """A byte of each component, for estimates."""
    return (_mix(sig.view(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)


def overlaps(a, b) -> bool:
    """True if two bags' multiset overlap is the threshold or more."""
    (ea, ca), (eb, cb) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    na, nb = int(ca.sum()), int(cb.sum())
    p, q = THRESHOLD
    if not na or not nb or q * min(na, nb) < p * max(na, nb):
        return False
    i = np.minimum(np.searchsorted(eb, ea), len(eb) - 1)
    same = int(np.minimum(ca, cb[i])[eb[i] == ea].sum())
    return q * same >= p * (na + nb - same)


@F.pandas_udf(T.StructType().add("n", T.LongType()).add("bands", T.ArrayType(T.LongType())).add("sig", T.BinaryType()))
def _sign(texts: pd.Series) -> pd.DataFrame:
    bags = [bag(t) for t in texts]
    full = [i for i, (e, _) in enumerate(bags) if len(e)]
    sig = signatures([bags[i] for i in full])
    keys, low = bands_of(sig), low_bytes(sig)
    bands, sigs = [np.empty(0, np.int64)] * len(bags), [b""] * len(bags)
    for k, i in enumerate(full):
        bands[i], sigs[i] = keys[k], low[k].tobytes()
    return pd.DataFrame({"n": [int(c.sum()) for _, c in bags], "bands": bands, "sig": sigs})


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, M) for s in (a, b))
    return pd.Series((x == y).sum(axis=1) >= LEAST_EQUAL)


@F.pandas_udf(T.BinaryType())
def _pack(texts: pd.Series) -> pd.Series:
    """Bags as bytes: the number of windows, the windows, and their counts unless all are 1."""
    return pd.Series([np.uint64(len(e)).tobytes() + e.tobytes() + (c.astype(np.uint32).tobytes() if c.max(initial=1) > 1 else b"") for e, c in map(bag, texts)], dtype=object)


def _unpack(raw):
    n = int(np.frombuffer(raw, np.uint64, 1)[0])
    e = np.frombuffer(raw, np.uint64, n, 8)
    return e, np.frombuffer(raw, np.uint32, n, 8 + 8 * n).astype(np.int64) if len(raw) > 8 + 8 * n else np.ones(n, np.int64)


@F.pandas_udf(T.BooleanType())
def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([overlaps(_unpack(x), _unpack(y)) for x, y in zip(a, b, strict=True)], dtype=bool)


def _step(df):
    """df, saved. What the steps before it shuffled goes first, else the disk holds the shuffles of all steps at once."""
    released(df.sparkSession)
    return saved(df)


def components(edges):
    """(node, root) for the nodes of edges (a, b): root is the least node that edges connect; roots have no row.

    Alternating large and small stars; each round is a few aggregations and joins, and ends in a checkpoint.
    """
    edges = _step(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    now = mark(edges)
    while now[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges, was = _step(small), now
        now = mark(edges)
        if tuple(now) == tuple(was):
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _verified(pairs, nodes, bags):
    """The pairs (a, b) that are links: first by signatures, then by bags."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sig = nodes.select("node", "sig")
    near = (pairs.join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b").join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
            .where(_alike("sa", "sb")).select("a", "b"))
    full = near.join(bags.select(F.col("node").alias("b"), F.col("bag").alias("gb")), "b").join(bags.select(F.col("node").alias("a"), F.col("bag").alias("ga")), "a")
    return _step(full.where(_linked("ga", "gb")).select("a", "b"))


def _near(rows):
    """The places of the rows, of a pair of blocks of a bucket, whose signatures are near one of another class."""
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(-1, M)
    names: dict = {}
    root = np.array([names.setdefault(bytes(r), i) for i, r in enumerate(rows["root"])])
    mine = rows["mine"].to_numpy()
    cross = mine.min() != mine.max()
    left = np.flatnonzero(mine == mine.min()) if cross else np.arange(len(rows))
    right = np.flatnonzero(mine != mine.min()) if cross else left
    if len(names) < 2:
        return np.empty(0, int)
    found, by_component = np.zeros(len(rows), bool), np.ascontiguousarray(sig.T)
    at_once = max(1, (1 << 22) // len(right))
    for i in range(0, len(left), at_once):
        xs = left[i:i + at_once]
        equal = np.zeros((len(xs), len(right)), np.uint8)
        for c in by_component:
            equal += c[xs][:, None] == c[right][None, :]
        hits = (equal >= LEAST_EQUAL) & (root[xs][:, None] != root[right][None, :])
        found[xs[hits.any(axis=1)]] = True
        found[right[hits.any(axis=0)]] = True
    return np.flatnonzero(found)


def _scan(batches):
    """Rows sorted by bucket and pair of blocks -> the (key, node) that go on. Holds one pair of blocks at a time."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        changes = (held[["key", "lo", "hi"]] != held[["key", "lo", "hi"]].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(changes)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            part = held.iloc[a:b].reset_index(drop=True)
            if len(near := _near(part)):
                yield part.loc[near, ["key", "node"]]
        held = held.iloc[starts[-1]:].reset_index(drop=True) if len(starts) else None
    if held is not None and len(held) and len(near := _near(held)):
        yield held.loc[near, ["key", "node"]]


def _dealt(rows, size):
    """rows of buckets (key) of n nodes, once for each other block of their bucket: plus mine, lo and hi."""
    blocks = F.ceil(F.col("n") / size)
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), blocks))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return rows.select("key", "node", "root", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))


def _joining(key, rows):
    """Links that join different roots among the rows of a pair of blocks of a bucket, as (a, b)."""
    if len(rows) < 2:
        return
    sig = np.frombuffer(b"".join(r.sig for r in rows), np.uint8).reshape(-1, M)
    bands = np.array([r.bands for r in rows])
    this = int(np.nonzero(bands[0] == key)[0][0])
    mine, cross = np.array([r.mine for r in rows]), len({r.mine for r in rows}) > 1
    names: dict = {}
    parent = list(range(len(rows)))
    start = np.array([names.setdefault(bytes(r.root), i) for i, r in enumerate(rows)])
    bags: dict = {}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x in range(len(rows) - 1):
        ys = np.arange(x + 1, len(rows))
        ys = ys[(start[ys] != start[x]) & ((mine[ys] != mine[x]) if cross else True)]
        if not len(ys):
            continue
        equal = (sig[ys] == sig[x]).sum(axis=1)
        ys, equal = ys[equal >= LEAST_EQUAL], equal[equal >= LEAST_EQUAL]
        first = (bands[ys] == bands[x]).argmax(axis=1) == this
        ys, equal = ys[first], equal[first]
        for y in ys[np.argsort(-equal, kind="stable")]:
            p, q = find(start[x]), find(start[y])
            if p != q:
                for i in (x, y):
                    if i not in bags:
                        bags[i] = _unpack(rows[i].bag)
                if overlaps(bags[x], bags[y]):
                    parent[max(p, q)] = min(p, q)
                    yield rows[x].node, rows[y].node


def _blocks(batches):
    """Rows sorted by bucket and pair of blocks -> links."""
    now, rows = None, []
    for batch in batches:
        found = []
        for r in batch.itertuples(index=False):
            if now != (r.key, r.lo, r.hi):
                found += _joining(now[0], rows) if now else []
                now, rows = (r.key, r.lo, r.hi), []
            rows.append(r)
        if found:
            yield pd.DataFrame(found, columns=["a", "b"])
    if now and (found := list(_joining(now[0], rows))):
        yield pd.DataFrame(found, columns=["a", "b"])


def classes(docs, id_col="doc_id", text_col="text"):
    """A row for each of docs: its id and class_id, the least id of its class."""
    rows = rooted(docs, id_col, text_col)
    # a saved table on either side of a join, and not an aggregation above the exchange, lets Spark split a hot key's rows
    least = _step(rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    return rows.join(least, "root").select("doc_id", "class_id", "class_size")


def node_of(text):
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def rooted(docs, id_col="doc_id", text_col="text"):
    """A row for each of docs: doc_id, node (what equal texts share) and root (what a class shares)."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), node_of(F.col(text_col)).alias("node"))
    signed = _step(docs.withColumn("s", _sign("text")).select("doc_id", "node", "s.bands", "s.sig"))
    nodes = _step(signed.where(F.size("bands") > 0).select("node", "bands", "sig").dropDuplicates(["node"]))
    rows = nodes.select("node", F.explode("bands").alias("key"))
    members = _step(rows.join(_step(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")), "key"))
    meets = members.groupBy("node").agg(F.sum("n").alias("meets"))
    bags = _step(docs.select("node", "text").dropDuplicates(["node"]).join(meets, "node", "left_semi").select("node", _pack("text").alias("bag")))

    leads = _step(members.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", "node"))["node"].alias("lead")))
    links = _verified(members.join(leads, "key").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")), nodes, bags)
    roots = components(links)
    rooted = members.where("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = _step(rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1"))
    rest = _dealt(rooted.join(mixed.select("key"), "key", "left_semi"), SCAN).join(nodes.select("node", "sig"), "node")
    near = _step(rest.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInPandas(_scan, "key long, node binary").distinct())
    near = near.join(_step(near.groupBy("key").agg(F.count("*").alias("n"))), "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = _dealt(near, BLOCK).join(nodes, "node").join(bags, "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    more = rest.mapInPandas(_blocks, "a binary, b binary")
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    return _step(signed.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root")))


def representatives(docs, id_col="doc_id", text_col="text"):
    """One row of each class of docs, with its columns: the one with the least id (null last), of equal ids the least text digest."""
    name = free_name(docs, "key")
    key = lambda i, node: F.sha2(F.concat(F.coalesce(i.cast("string"), F.lit("-")).cast("binary"), F.lit(b"|"), node), 256)
    first = rooted(docs, id_col, text_col).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("x"))
    chosen = first.select(key(F.col("x.doc_id"), F.col("x.node")).alias(name))
    rows = docs.withColumn(name, key(F.col(id_col), node_of(F.col(text_col)))).join(chosen, name)
    return rows.dropDuplicates([name]).select(*docs.columns)  # by the join's partitioning: only rows equal in id and text meet


def query(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir):
    """One document of each group, with its columns."""
    return representatives(docs)
