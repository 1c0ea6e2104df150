"""Registered queries against their SQL, and the entry point."""

import duckdb
import pandas as pd
import pytest

from tapewatch.plans import catalog
from tapewatch.plans.catalog import QUERIES
from tapewatch.plans.oracle import ORACLES
from tapewatch.sources.shared import staged

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared_steps():
    """Steps that many queries share are computed once for this module."""

    def once(f):
        known = {}

        def step(spark, *asked):
            if not all(isinstance(x, str) for x in asked):
                return f(spark, *asked)
            if asked not in known:
                found = f(spark, *asked)
                known[asked] = tuple(map(staged, found)) if isinstance(found, tuple) else staged(found)
            return known[asked]

        return step

    with pytest.MonkeyPatch.context() as patch:
        for name in ("_trades", "_bets", "_records", "_gated", "_published", "_engine", "_pairs", "_positions"):
            patch.setattr(catalog, name, once(getattr(catalog, name)))
        yield


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime64"):
            df[c] = pd.to_datetime(df[c], utc=True).astype("datetime64[us, UTC]").astype(str)
    df = df.astype(object).where(df.notna(), None)
    plain = lambda x: x if x is None or isinstance(x, (bool, str)) else round(float(x), 6) if hasattr(x, "__float__") else str(x)
    return sorted(str([plain(x) for x in r]) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_all_but_sketches_and_draws_have_sql():
    assert set(QUERIES) - set(ORACLES) == {"null_test", "observed_wallets", "stream_distinct"} and set(ORACLES) <= set(QUERIES)


def test_streamed_sketch_is_near(spark, duck):
    exact = duck.execute("select count(distinct user_id) from events").fetchall()[0][0]
    assert abs(QUERIES["stream_distinct"](spark, SF).first()["n"] - exact) <= max(1, 0.05 * exact)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["cond", "wallet", "buyers", "z_bet", "z_profit"]


def test_sketch_is_near(spark, duck):
    exact = duck.execute("select count(distinct o_custkey) from orders join lineitem on o_orderkey = l_orderkey").fetchall()[0][0]
    assert abs(QUERIES["observed_wallets"](spark, SF).first()["n"] - exact) <= 0.05 * exact


def test_null_test_facts(spark):
    row = QUERIES["null_test"](spark, SF).first()
    assert 0 < row["p"] <= 1 and row["n"] >= row["observed"]


def test_null_test_takes_all_draws(spark):
    import math

    from tapewatch.operators import validation

    p = QUERIES["null_test"](spark, SF).first()["p"]
    assert p * 10_001 == pytest.approx(round(p * 10_001), abs=1e-6)
    bets = spark.createDataFrame([(i, 0.5, i < 26) for i in range(40)] + [(40, 1.0, True), (41, 0.0, False), (42, None, False)], "bet_id long, p double, won boolean")
    one, two = (validation.null_test(bets, parts=k).first()["p"] for k in (1, 7))
    tail = sum(math.comb(40, k) for k in range(26, 41)) / 2**40
    assert one == two and abs(one - tail) <= 4 * math.sqrt(tail * (1 - tail) / 10_000)
