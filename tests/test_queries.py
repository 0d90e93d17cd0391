"""Registered queries against their SQL on the smallest tables."""

import math
import os

import pytest

from pleat.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(rows):
    def one(v):
        return round(float(v), 3) + 0.0 if isinstance(v, float) or hasattr(v, "as_tuple") else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = norm(df.select(*cols).collect())
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = norm([tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()])
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-3))


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE)


#: Tables whose results are halves in the last place kept, where a shortest decimal form and binary scaling differ.
HALVES = {
    "apl_power": [1.63, 58.37, 346.53, 20.33, 50.91, 89.71, 14.27],
    "complex_polar": [6.55, 73.15, 12.75, 224.25, 0.15, 8.45, 56.05, 15.25, 1.35, 0.0, 3100.05],
    "power_three": [1.63, 58.37, 346.53, 20.33, 50.91, 89.71, 14.27],
    "returns": [24.0, 92.13, 59.2, 28.49, 8.0, 21.49, 3.2, 5.26],
}


@pytest.mark.parametrize("name", sorted(HALVES))
def test_halves_round_as_in_the_sql(spark, tmp_path, name):
    import duckdb

    df = spark.createDataFrame(list(enumerate(HALVES[name])), "event_id long, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select("pos", "v").orderBy("pos").collect()]
    assert got == c.execute(f"select pos, v from ({ORACLE[name]}) order by pos").fetchall()
