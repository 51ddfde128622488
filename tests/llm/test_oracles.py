import duckdb
import pytest

from threadmill.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF), con.sql(registry.oracles()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted((tuple(r) for r in got.select(*columns).collect()), key=str)
    b = sorted(want.project(", ".join(columns)).fetchall(), key=str)
    assert len(a) == len(b) > 0
    assert a == b


def test_registered():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names[:-1]] == [f"op{i}" for i in range(1, 11)] and names[-1] == "pipeline"
