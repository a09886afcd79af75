import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pitlane.functions import metrics, panel
from pitlane.operators import asof, calendar, portfolio
from pitlane.plans import registry, research  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(pdf, columns):
    pdf = pdf[columns].astype(object)
    return sorted(map(repr, pdf.where(pdf.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.ORACLES) <= set(__spark_entry__.queries())


def prices(spark, data):
    df = spark.createDataFrame(data, "symbol string, session string, open double, close double")
    return df.withColumn("session", F.col("session").cast("date"))


def test_schedule_of_business_days(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-03-01')) as session").where("dayofweek(session) not in (1, 7)").limit(45)
    c = calendar.sessions(days)
    assert 8 <= calendar.decisions(c, "weekly").count() <= 10
    assert calendar.decisions(c, "monthly").count() == 3
    with pytest.raises(ValueError):
        calendar.decisions(c, "yearly")


def test_lookback_counts_sessions_not_rows(spark):
    p = prices(spark, [("A", f"2024-01-0{i}", 1.0, float(i)) for i in (1, 2, 4)] + [("B", f"2024-01-0{i}", 1.0, 1.0) for i in range(1, 5)])
    px = calendar.numbered(p, calendar.sessions(p)).withColumn("r", panel.change(1)).where("symbol = 'A'").orderBy("n")
    assert [x.r for x in px.collect()] == [None, 1.0, None]


def test_rank_ties_nulls_and_singletons(spark):
    df = spark.createDataFrame([("d", "A", 1.0), ("d", "B", 2.0), ("d", "C", None), ("e", "A", 5.0), ("f", "A", 1.0), ("f", "B", 1.0)], "d string, s string, v double")
    half = {(r.d, r.s): r.p for r in df.withColumn("p", panel.pct_rank("v", ["d"], True)).collect()}
    assert half == {("d", "A"): 0.5, ("d", "B"): 1.0, ("d", "C"): None, ("e", "A"): 0.5, ("f", "A"): 0.75, ("f", "B"): 0.75}


def test_winsorize_and_combine(spark):
    df = spark.range(100).select(F.lit("d").alias("d"), F.col("id").cast("double").alias("v"))
    assert panel.winsorized(df, "v", ["d"], 0.1, 0.9).agg(F.min("v")).first()[0] == pytest.approx(9.9)
    one = spark.createDataFrame([(0.5, 0.2), (None, 0.4), (None, None)], "a double, b double")
    got = [r[0] for r in one.select(panel.combined([("a", 0.75), ("b", 0.25)])).collect()]
    assert got[0] == pytest.approx(0.425) and got[1] == pytest.approx(0.4) and got[2] is None
    with pytest.raises(ValueError):
        panel.combined([("a", -1.0)])


def test_feature_needs_both_clocks(spark):
    f = spark.createDataFrame([("A", "q", "2024-01-01", "2024-02-10", 0, 1.0), ("A", "q", "2024-03-01", "2024-02-01", 0, 2.0)], "symbol string, feature string, observed_at string, available_at string, revision int, value double")
    f = f.withColumns({c: F.col(c).cast("date") for c in ("observed_at", "available_at")})
    at = spark.createDataFrame([("2024-02-05",), ("2024-02-10",), ("2024-03-01",)], "t string").select(F.col("t").cast("date").alias("t"))
    assert [(str(r.t), r.value) for r in asof.latest_features(f, at).orderBy("t").collect()] == [("2024-02-10", 1.0), ("2024-03-01", 2.0)]


def test_drift_turnover_and_cash(spark):
    sched = spark.createDataFrame([("2024-01-01", "2024-01-02", "2024-02-02"), ("2024-02-01", "2024-02-02", "2024-03-02")], "decision string, execution string, exit string")
    held = spark.createDataFrame([("2024-01-01", "AAA", 0.5, 0.1), ("2024-02-01", "BBB", 0.5, 0.0)], "decision string, symbol string, weight double, period_return double")
    d = portfolio.drifted(held).where("symbol = 'AAA'").first()
    assert d.drifted == pytest.approx(0.55 / 1.05)
    turn = {r.decision: r.turnover for r in portfolio.turnover(held, sched).collect()}
    assert turn["2024-01-01"] == pytest.approx(0.5)
    assert turn["2024-02-01"] == pytest.approx(0.5 * (0.5 + 0.55 / 1.05 + abs(0.5 - 0.5 / 1.05)))


def test_weights_cap_stays_cash(spark):
    picks = spark.createDataFrame([("d", "A", 2.0, 1), ("d", "B", 1.0, 2)], "decision string, symbol string, score double, position int")
    w = {r.symbol: r.weight for r in portfolio.weights(picks, "rank", 0.4).collect()}
    assert w["A"] == 0.4 and w["B"] == pytest.approx(1 / 3)
    assert {r.symbol: round(r.weight, 6) for r in portfolio.weights(picks, "score").collect()} == {"A": 1.0, "B": 0.0}
    with pytest.raises(ValueError):
        portfolio.top(picks, 0)


def test_metrics_of_few_and_no_rows(spark):
    r = spark.createDataFrame([(0.02,), (-0.01,), (0.03,), (-0.02,), (0.01,), (0.04,)], "strategy_return double")
    m = metrics.core(r, 12.0).first()
    assert m.total_return == pytest.approx(math.prod((1.02, 0.99, 1.03, 0.98, 1.01, 1.04)) - 1)
    empty = metrics.core(r.where("false"), 12.0).first()
    assert empty.periods == 0 and empty.sharpe is None


def test_imports_without_text_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "pitlane.llm.queries", None)  # importing it now fails
    assert not any(n.startswith("op") for n in __spark_entry__.queries())
    assert os.path.exists(registry.__file__)
