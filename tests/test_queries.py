import duckdb
import pandas as pd
import pytest

from threadmill.plans import archive_queries as q
from threadmill.plans import export_queries

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    value = lambda v: tuple(map(value, v)) if hasattr(v, "__len__") and not isinstance(v, str) else None if v is None or v != v else round(float(v), 9) if isinstance(v, float) else v
    return sorted((tuple(value(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_against_oracle(spark, db, name):
    got, want = q.QUERIES[name](spark, SF), db.sql(q.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical(got.toPandas()), canonical(want.df())
    assert len(a) == len(b) > 0
    assert a == b


def test_unique_ids_against_a_loop(spark):
    rows = q.unique_thread_id(spark, SF).orderBy("p_partkey").collect()
    used = set()
    for r in rows:
        want, n = r.base, 2
        while want in used:
            want, n = f"{r.base}_{n}", n + 1
        used.add(want)
        assert r.thread_id == want


def test_mojibake_of_all_documents_against_a_loop(spark):
    def repair(t):
        if t is None or not set(t) & set("ÄÅÃ"):
            return t
        try:
            return t.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return t

    texts = {r.doc_id: r.text for r in q.table(spark, SF, "documents").collect()}
    got = q.mojibake_all(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id]
        assert r.kept == repair(t) and r.repaired == (None if t is None else repair(t.encode("utf-8").decode("latin-1")))


@pytest.mark.parametrize("name", sorted(export_queries.ORACLES))
def test_exports_sinks_and_pictures_against_oracle(spark, db, name):
    got, want = export_queries.QUERIES[name](spark, SF), db.sql(export_queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical(got.toPandas()), canonical(want.df())
    assert len(a) == len(b) > 0
    assert a == b


def test_threads_at_the_fractions_of_a_bound(spark, tmp_path):
    times = ["2024-01-09 23:59:59.999", "2024-01-10", "2024-01-10 06:00:00", "2024-01-10 06:00:00.000900", "2024-01-10 06:00:00.001", "2024-01-10 06:00:00.999", "2024-01-10 06:00:01", "2024-01-10 03:00"]
    users = pd.array([0, 1, 2, 3, 4, 5, 6, None], dtype="Int64")
    pd.DataFrame({"event_id": range(8), "ts": pd.to_datetime(pd.Series(times), format="ISO8601").astype("datetime64[us]"), "user_id": users, "event_type": "view", "value": 0.0, "props": "{}"}).to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = [r.thread_key for r in export_queries.QUERIES["empty_threads_dropped"](spark, str(tmp_path)).collect()]
    want = [r[0] for r in con.sql(export_queries.ORACLES["empty_threads_dropped"]).fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str) == ["1", "2", "3", None]
