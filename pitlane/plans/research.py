"""Registered queries of contracts, signals, folds, reviews and perturbations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane.audit import causality, rules
from pitlane.functions import metrics
from pitlane.operators import asof, calendar, portfolio, signals, walkforward
from pitlane.operators.strategy import Strategy, View
from pitlane.plans.registry import _AT, _P, _PER, _PX, _SIG, BPS, LOOKBACK, _at, _held, _periods, _schedule, _signals, register, rounded, text
from pitlane.sources import provider
from pitlane.sources.bundle import Bundle
from pitlane.sources.canonical import oracle_ctes
from pitlane.sources.contracts import CONTRACTS, Request
from pitlane.sources.files import scan

# -- contracts: raw tables with planted faults, as text, valid in both engines --------------

_DIRTY = {
    "prices": """select case when o_orderkey % 41 = 0 then '  ' else concat(' sym', cast(o_custkey % 90 as varchar(10))) end as symbol,
  case when o_orderkey % 43 = 0 then 'soon' else cast(cast(o_orderdate as date) as varchar(10)) end as "timestamp", case when o_orderkey % 47 = 0 then 'n/a' else cast(o_orderkey as varchar(20)) end as open,
  case when o_orderkey % 59 = 0 then null else '7.5' end as high, '1' as low, case when o_orderkey % 61 = 0 then '' else '2e1' end as close, case when o_orderkey % 7 = 0 then 'none' else '5' end as volume,
  case when o_orderkey % 53 = 0 then ' ' else 'orders' end as source, o_orderkey as extra from {orders}""",
    "features": """select case when o_orderkey % 41 = 0 then null else 'x' end as symbol, cast(cast(o_orderdate as date) as varchar(10)) as observed_at, case when o_orderkey % 43 = 0 then '2024-13-01' else '2024-01-02' end as available_at,
  case when o_orderkey % 47 = 0 then ' ' else ' total ' end as feature, cast(o_totalprice as varchar(30)) as value, case when o_orderkey % 59 = 0 then 'two' when o_orderkey % 5 = 0 then null else cast(o_custkey % 300 as varchar(10)) end as revision, 'orders' as source from {orders}""",
    "events": """select concat('u', cast(user_id % 9 as varchar(10))) as symbol, cast(ts as varchar(30)) as event_at, case when event_id % 43 = 0 then 'later' else cast(cast(ts as date) as varchar(10)) end as available_at, case when event_id % 47 = 0 then '' else event_type end as event_type,
  case when event_id % 31 = 0 then '[1, 2]' when event_id % 37 = 0 then '5' when event_id % 29 = 0 then 'broken' when event_id % 11 = 0 then null else props end as payload, case when event_id % 53 = 0 then null else 'app' end as source from {events}""",
    "universe": """select concat('c', cast(c_custkey as varchar(10))) as symbol, case when c_custkey % 41 = 0 then '' else '2020-01-01' end as effective_from, case when c_custkey % 5 = 0 then '2019-06-30' when c_custkey % 7 = 0 then '2020-01-01' when c_custkey % 11 = 0 then 'never' when c_custkey % 3 = 0 then null else '2021-01-01' end as effective_to,
  case when c_custkey % 43 = 0 then null else '2020-01-01' end as available_at, 'customers' as source from {customer}""",
}
_RULES = {
    "prices": ({"blank_symbol": "coalesce(trim(symbol), '') = ''", "bad_timestamp": 'try_cast("timestamp" as timestamp) is null', **{f"bad_{c}": f"try_cast({c} as double) is null" for c in ("open", "high", "low", "close")}, "blank_source": "coalesce(trim(source), '') = ''"}, 'upper(trim(symbol)), try_cast("timestamp" as timestamp)'),
    "features": ({"blank_symbol": "coalesce(trim(symbol), '') = ''", "bad_observed_at": "try_cast(observed_at as timestamp) is null", "bad_available_at": "try_cast(available_at as timestamp) is null", "blank_feature": "coalesce(trim(feature), '') = ''", "bad_revision": "revision is not null and try_cast(revision as int) is null", "blank_source": "coalesce(trim(source), '') = ''"}, "symbol, observed_at, try_cast(available_at as timestamp), trim(feature), case when revision is null then 0 else try_cast(revision as int) end"),
    "events": ({"blank_symbol": "coalesce(trim(symbol), '') = ''", "bad_event_at": "try_cast(event_at as timestamp) is null", "bad_available_at": "try_cast(available_at as timestamp) is null", "blank_event_type": "coalesce(trim(event_type), '') = ''", "payload_no_object": "payload is not null and not (json_valid(payload) and coalesce(json_type(case when json_valid(payload) then payload end) = 'OBJECT', false))", "blank_source": "coalesce(trim(source), '') = ''"}, None),
    "universe": ({"blank_symbol": "coalesce(trim(symbol), '') = ''", "bad_effective_from": "try_cast(effective_from as timestamp) is null", "bad_available_at": "try_cast(available_at as timestamp) is null", "bad_effective_to": "effective_to is not null and try_cast(effective_to as timestamp) is null", "empty_interval": "coalesce(try_cast(effective_to as timestamp) <= try_cast(effective_from as timestamp), false)", "blank_source": "coalesce(trim(source), '') = ''"}, None),
}


def _dirty(t, kind: str):
    return t._sql(_DIRTY[kind].replace('"timestamp"', "`timestamp`"))


def _contract_sql(kind: str) -> str:
    sources = {s: s for s in ("orders", "events", "customer")}
    listed, key = _RULES[kind]
    out = f"with dirty as ({_DIRTY[kind].format(**sources)}) " + " union all ".join(f"select '{r}' as rule, count(*) as n from dirty where {c}" for r, c in listed.items())
    return out + (f" union all select 'duplicate_key', cast(coalesce(sum(n - 1), 0) as bigint) from (select count(*) as n from dirty group by {key})" if key else "")


for _kind in CONTRACTS:

    @register(f"contract_{_kind}", _contract_sql(_kind))
    def _contract(t, kind=_kind):
        return CONTRACTS[kind].violations(_dirty(t, kind))


@register("contract_clean_prices", f"""with dirty as ({_DIRTY['prices'].format(orders='orders')}) select upper(trim(symbol)) as symbol, cast(cast(try_cast("timestamp" as timestamp) as date) as varchar) as day, try_cast(open as double) as open, try_cast(volume as double) as volume, extra from dirty
 where trim(symbol) <> '' and try_cast("timestamp" as timestamp) is not null and try_cast(open as double) is not null""")
def contract_clean_prices(t):
    rows = CONTRACTS["prices"].clean(_dirty(t, "prices")).where("symbol <> '' and timestamp is not null and open is not null")
    return rows.select("symbol", F.to_date("timestamp").cast("string").alias("day"), "open", "volume", "extra")


@register("scan_parquet", "select n_nationkey, n_name, n_regionkey from nation")
def scan_parquet(t):
    return scan(t.spark, f"{t.path}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")


_REQUEST = Request("1995-03-01", "1996-06-30", ("brand#11", " BRAND#23 ", "BRAND#11"))


def _bundle(t) -> Bundle:
    at = lambda df, *days: df.withColumns({d: F.col(d).cast("timestamp") for d in days})
    prices = at(t.prices.withColumnRenamed("session", "timestamp"), "timestamp").withColumn("source", F.lit("driver"))
    features = at(t.features, "observed_at", "available_at").withColumns({"source": F.lit("driver"), "value_num": F.col("value").cast("double")}).withColumn("value", F.col("value").cast("string"))
    return Bundle(prices, features, at(t.events, "event_at", "available_at"), at(t.universe, "effective_from", "effective_to", "available_at"), {"price_adjustment": "unknown"}, t.more)


@register("request_select", oracle_ctes("prices", "features", "known_events", "universe") + """ select 'prices' as kind, count(*) as n, count(distinct symbol) as symbols from prices where symbol in ('BRAND#11', 'BRAND#23') and session between date '1995-03-01' and date '1996-06-30'
 union all select 'features', count(*), count(distinct symbol) from features where symbol in ('BRAND#11', 'BRAND#23') and observed_at between date '1995-03-01' and date '1996-06-30'
 union all select 'events', count(*), count(distinct symbol) from known_events where symbol in ('BRAND#11', 'BRAND#23') and event_at between date '1995-03-01' and date '1996-06-30' union all select 'universe', count(*), count(distinct symbol) from universe where symbol in ('BRAND#11', 'BRAND#23')""")
def request_select(t):
    b = _bundle(t).select(_REQUEST)
    parts = [b.table(k).agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols")).select(F.lit(k).alias("kind"), "n", "symbols") for k in CONTRACTS]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@register("snapshot_as_of", oracle_ctes("prices", "features", "known_events", "universe") + " select 'prices' as kind, count(*) as n from prices where session <= date '1996-07-01' union all select 'features', count(*) from features where available_at <= date '1996-07-01' and observed_at <= date '1996-07-01' union all select 'events', count(*) from known_events where available_at <= date '1996-07-01' union all select 'universe', count(*) from universe where available_at <= date '1996-07-01'")
def snapshot_as_of(t):
    b = _bundle(t).as_of("1996-07-01")
    parts = [b.table(k).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k in CONTRACTS]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@register("price_history", _P + " select symbol, cast(session as varchar) as session, close from prices where symbol in ('BRAND#12', 'BRAND#31') and session in (select distinct session from prices where symbol in ('BRAND#12', 'BRAND#31') order by session desc limit 6)")
def price_history(t):
    return asof.last_sessions(t.prices, 6, ("BRAND#12", "BRAND#31")).select("symbol", *text("session"), "close")


@register("feature_history", oracle_ctes("features") + " select cast(observed_at as varchar) as observed_at, cast(available_at as varchar) as available_at, revision, value from features where symbol = 'BRAND#22' and feature = 'discount'")
def feature_history(t):
    return t.features.where("symbol = 'BRAND#22' and feature = 'discount'").select(*text("observed_at", "available_at"), "revision", "value")


@register("events_of_type", oracle_ctes("known_events") + ", asked as (select date '2000-01-12' as t) select symbol, event_type, count(*) as n, count(*) filter (where event_at > t) as ahead from asked join known_events on available_at <= t where event_type = (select min(event_type) from known_events) group by all")
def events_of_type(t):
    at = t.spark.sql("select date'2000-01-12' as t")
    kind = t.events.agg(F.min("event_type").alias("event_type"))
    rows = asof.known_events(t.events.join(F.broadcast(kind), "event_type"), at, include_future=True)
    return rows.groupBy("symbol", "event_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("event_at") > F.col("t"), 1)).alias("ahead"))


# -- signals --------------------------------------------------------------------------------

_RAW = "select decision, case when symbol like '%1' then concat(' ', lower(symbol)) else symbol end as symbol, case when symbol like '%5' then null else score end as score, symbol not like '%5' and symbol not like '%24' as eligible, repeat(symbol, 200) as rationale from sig"


def _raw(t):
    s = F.col("symbol")
    return _signals(t).select("decision", F.when(s.like("%1"), F.concat(F.lit(" "), F.lower(s))).otherwise(s).alias("symbol"), F.when(s.like("%5"), None).otherwise(F.col("score")).alias("score"), (~s.like("%5") & ~s.like("%24")).alias("eligible"), F.repeat(s, 200).alias("rationale"))


@register("signals_normalised", _P + _SIG + f", raw as ({_RAW}) select cast(decision as varchar) as decision, upper(trim(symbol)) as symbol, score, eligible, substring(rationale, 1, 1000) as rationale from raw")
def signals_normalised(t):
    return signals.normalise(_raw(t)).select(*text("decision"), "symbol", "score", "eligible", "rationale")


@register("signal_violations", _P + _SIG + """, raw as (select decision, symbol, case when symbol like '%4' then 'nan'::double else score end as score, true as eligible from sig union all select decision, lower(symbol), score, true from sig where symbol like '%2' union all select decision, ' ', 1.0, true from sig where symbol like '%33')
 select 'blank_symbol' as rule, count(*) as n from raw where trim(symbol) = '' union all select 'eligible_without_score', count(*) from raw where isnan(score) or score is null union all select 'duplicate_symbol', cast(coalesce(sum(n - 1), 0) as bigint) from (select count(*) as n from raw group by decision, upper(trim(symbol)))""")
def signal_violations(t):
    s = _signals(t)
    nan = F.when(F.col("symbol").like("%4"), F.lit(float("nan"))).otherwise(F.col("score"))
    raw = s.withColumn("score", nan).unionByName(s.where("symbol like '%2'").withColumn("symbol", F.lower("symbol"))).unionByName(s.where("symbol like '%33'").withColumns({"symbol": F.lit(" "), "score": F.lit(1.0)}))
    return signals.violations(signals.normalise(raw))


_RESTRICT = oracle_ctes("prices", "universe") + _SIG + """, mem as (select distinct decision, u.symbol from dec join universe u on u.available_at <= decision and effective_from <= decision and (effective_to is null or effective_to > decision)),
cnt as (select decision, p.symbol, count(*) as k from dec join prices p on p.session <= decision group by all), res as (select s.decision, s.symbol, s.score, m.symbol is not null and coalesce(c.k, 999) >= 80 as eligible,
 case when c.k < 80 then 'short' when m.symbol is null then 'outside' else '' end as why from sig s left join mem m on m.decision = s.decision and m.symbol = s.symbol left join cnt c on c.decision = s.decision and c.symbol = s.symbol)"""


def _restricted(t):
    runs = t.prices.select("symbol", "session", F.row_number().over(Window.partitionBy("symbol").orderBy("session")).cast("double").alias("close"))
    counts = asof.latest_prices(runs, _at(t)).select(F.col("t").alias("decision"), "symbol", F.col("close").cast("long").alias("sessions"))
    members = asof.members(t.universe, _at(t)).withColumnRenamed("t", "decision")
    return signals.restrict(signals.normalise(_signals(t)), members, counts, 80)


@register("eligibility_override", _RESTRICT + " select cast(decision as varchar) as decision, symbol, eligible, why from res")
def eligibility_override(t):
    why = F.when(F.col("rationale").startswith("history"), "short").when(F.col("rationale").startswith("not"), "outside").otherwise("")
    return _restricted(t).select(*text("decision"), "symbol", "eligible", why.alias("why"))


@register("top_of_eligible", _RESTRICT + " select cast(decision as varchar) as decision, symbol, position from (select *, row_number() over (partition by decision order by score desc, symbol) as position from res where eligible and score >= -0.1) where position <= 4")
def top_of_eligible(t):
    return portfolio.top(_restricted(t).where("eligible"), 4, -0.1).select(*text("decision"), "symbol", "position")


@register("restrict_to_members", oracle_ctes("prices", "universe") + _SIG + """, mem as (select distinct decision, u.symbol from dec join universe u on u.available_at <= decision and effective_from <= decision and (effective_to is null or effective_to > decision))
 select cast(s.decision as varchar) as decision, s.symbol, s.score from sig s where not exists (select 1 from mem m where m.decision = s.decision) or exists (select 1 from mem m where m.decision = s.decision and m.symbol = s.symbol)""")
def restrict_to_members(t):
    """Active members only, or all symbols where a date has no member."""
    view = View(_bundle(t), _schedule(t).select(F.col("decision").cast("timestamp").alias("decision")))
    rows = view.restrict_to_members(_signals(t).withColumn("decision", F.col("decision").cast("timestamp")))
    return rows.select(F.to_date("decision").cast("string").alias("decision"), "symbol", "score")


@register("signal_changes", _P + _SIG + """, sm as (select decision, symbol, score from sig where score > 0), lg as (select decision, symbol, score from sig where abs(score) > 0.05) select cast(decision as varchar) as decision, symbol, count(*) as n from (select * from (select * from sm except all select * from lg) union all select * from (select * from lg except all select * from sm)) group by all""")
def signal_changes(t):
    """Rows that two signal tables don't share, told both ways."""
    s = _signals(t)
    a, b = s.where("score > 0"), s.where("abs(score) > 0.05")
    return a.exceptAll(b).unionAll(b.exceptAll(a)).groupBy(*text("decision"), "symbol").agg(F.count("*").alias("n"))


@register("canonical_order", _P + " select symbol, cast(session as varchar) as session, row_number() over (order by session, symbol) as place from prices qualify place <= 40")
def canonical_order(t):
    """The first rows of prices in canonical order, numbered."""
    first = t.prices.orderBy("session", "symbol").limit(40)
    return first.select("symbol", *text("session"), F.row_number().over(Window.orderBy("session", "symbol")).cast("long").alias("place"))


_NORM = _P + _PX + _AT.replace(", sess as (select session, row_number() over (order by session) as n from (select distinct session from prices))", "") + """, rets as (select a.symbol, a.session, a.n, a.close, a.close / b.close - 1 as ret from px a left join px b on a.symbol = b.symbol and b.n = a.n - 1),
vol as (select *, case when count(ret) over f = 12 then stddev_samp(ret) over f end as v from rets window f as (partition by symbol order by n range between 11 preceding and current row))"""


@register("normalised_momentum", _NORM + " select cast(d.decision as varchar) as decision, a.symbol, round((a.close / b.close - 1) / nullif(a.v, 0), 8) as value from vol a join vol b on b.symbol = a.symbol and b.n = a.n - 8 join dec d on d.decision = a.session where a.v is not null and a.v <> 0")
def normalised_momentum(t):
    view = View(_bundle(t), _schedule(t).select(F.col("decision").cast("timestamp").alias("decision")))
    return view.normalised_momentum(8, 12).select(F.to_date("decision").cast("string").alias("decision"), "symbol", F.round("value", 8).alias("value"))


class _Momentum(Strategy):
    """Momentum over eight sessions, said as a plan."""

    name, minimum_history = "momentum", 9

    def scores(self, view):
        return view.trailing_momentum(LOOKBACK).withColumnRenamed("value", "score")


class _PythonMomentum(Strategy):
    """The same, said in Python for one snapshot; 30 sessions are all it looks at."""

    name, minimum_history, lookback_sessions = "momentum", 9, 30

    def score(self, snapshot):
        return snapshot.trailing_momentum(8)


_STRATEGY = _RESTRICT.replace(">= 80", ">= 9").replace("< 80", "< 9") + " select cast(decision as varchar) as decision, symbol, round(score, 8) as score, eligible from res"
for _name, _cls in (("strategy_declarative", _Momentum), ("strategy_opaque", _PythonMomentum)):

    @register(_name, _STRATEGY)
    def _strategy(t, cls=_cls):
        decided = _schedule(t).select(F.col("decision").cast("timestamp").alias("decision"))
        rows = cls().signals(_bundle(t), decided).where("score is not null")
        return rows.select(F.to_date("decision").cast("string").alias("decision"), "symbol", F.round("score", 8).alias("score"), "eligible")


# -- metrics and folds ----------------------------------------------------------------------


@register("metrics_summary", _P + _PER + """, eq as (select exit, product(1 + strategy_return) over (order by exit) as e from per), dd as (select min(x) as mdd from (select e / max(e) over (order by exit) - 1 as x from eq)),
a as (select count(*) as periods, product(1 + strategy_return) as g, avg(turnover) as av, avg(gross_exposure) as ex from per) select periods, round(ln(g), 8) as log_growth, round(mdd, 8) as max_drawdown, round((pow(g, 12.0 / periods) - 1) / abs(mdd), 8) as calmar, round(av, 8) as average_turnover, round(av * 12, 8) as annual_turnover, round(ex, 8) as average_gross_exposure from a, dd""")
def metrics_summary(t):
    out = metrics.summary(_periods(t), 12.0).withColumn("log_growth", F.log1p("total_return"))
    return out.select("periods", *rounded("log_growth", "max_drawdown", "calmar", "average_turnover", "annual_turnover", "average_gross_exposure"))


_WF = walkforward.WalkForwardConfig(12, 6, 2)
_SEG = _PER + f""", dn as (select decision, row_number() over (order by decision) as n from dec), cnt as (select count(*) as total from dn), f as (select unnest(range(0, (select (total - {_WF.needed}) // {_WF.test_periods} from cnt) + 1)) as fold),
at0 as (select fold, n - fold * {_WF.test_periods} as pos, p.decision, p.exit, p.gross_return, p.turnover, p.gross_exposure from f, dn join per p using (decision)),
seg as (select fold, case when pos between 1 and {_WF.train_periods - 1} then 'train' when pos between {_WF.train_periods + _WF.embargo_periods + 1} and {_WF.needed - 1} then 'test' end as part, decision, exit,
 gross_return - case when pos in (1, {_WF.train_periods + _WF.embargo_periods + 1}) then gross_exposure else turnover end * {BPS} / 1e4 as net from at0)"""


def _segments(t):
    schedule = _schedule(t)
    numbered = schedule.select("decision", F.row_number().over(Window.orderBy("decision")).alias("n"))
    return walkforward.segments(_periods(t).join(F.broadcast(numbered), "decision"), schedule.count(), _WF, BPS)


@register("walkforward_segments", _P + _SEG + " select fold, part, count(*) as periods, round(ln(product(1 + net)), 8) as log_growth, round(coalesce(case when stddev_samp(net) > 0 then avg(net) / stddev_samp(net) end, 0), 8) as sharpe from seg where part is not null group by fold, part")
def walkforward_segments(t):
    rows = walkforward.fold_table(_segments(t))
    return rows.select(F.col("fold").cast("long").alias("fold"), "part", "periods", F.round(F.log1p("total_return"), 8).alias("log_growth"), F.round("sharpe", 8).alias("sharpe"))


@register("walkforward_pooled", _P + _SEG + " select count(*) as periods, round(ln(product(1 + net)), 8) as log_growth, count(distinct fold) as folds from seg where part = 'test'")
def walkforward_pooled(t):
    return _segments(t).where("part = 'test'").agg(F.count("*").alias("periods"), F.round(F.log(F.product(1 + F.col("net"))), 8).alias("log_growth"), F.countDistinct("fold").alias("folds"))


# -- reviews --------------------------------------------------------------------------------

_LEAKY = oracle_ctes("prices", "leaky")


@register("finding_triggers", _LEAKY + _PER + f""", s as (select abs(sum(weight * period_return)) as c from held group by symbol), k as (select c, row_number() over (order by c desc) as r from s), pr as (select abs(strategy_return) as a, row_number() over (order by abs(strategy_return) desc) as r from per),
fo as (select ntile(4) over (order by exit) as f, strategy_return as x from per), ft as (select product(1 + x) - 1 as g from fo group by f),
cov as (select min(n) as lo, median(n) as md from (select count(distinct session) as n from prices group by symbol)),
m as (select count(*) as n, sum(gross_return) as g, sum(turnover) as tu, avg(strategy_return) * 12 / (stddev_samp(strategy_return) * sqrt(12.0)) as sh, product(1 + strategy_return) - 1 as tr, product(1 + benchmark_return) - 1 as br from per)
select 'DATA_PRICE_INVARIANT' as code, (select count(*)::double from prices where high < greatest(open, close) or low > least(open, close, high) or least(open, high, low, close) <= 0 or volume < 0) as measured, (select count(*) > 0 from prices where high < greatest(open, close) or low > least(open, close, high) or least(open, high, low, close) <= 0 or volume < 0) as fires
union all select 'DATA_TEMPORAL_LEAK', count(*)::double, count(*) > 0 from leaky where available_at < observed_at
union all select 'DATA_COVERAGE_UNEVEN', lo::double, lo < greatest(20, floor(md * 0.5)) from cov
union all select 'PERFORMANCE_SAMPLE_SMALL', n::double, n < 24 from m union all select 'PERFORMANCE_EXTREME_SHARPE', round(sh, 8), abs(sh) > 3 from m
union all select 'COST_FRAGILE', round(g / tu * 1e4, 6), g / tu * 1e4 <= 1.5 * {BPS} from m
union all select 'SYMBOL_CONCENTRATION', round(sum(case when r <= 3 then c end) / sum(c), 8), sum(case when r <= 3 then c end) / sum(c) > 0.6 from k
union all select 'RETURN_CONCENTRATION', round(sum(case when r <= 3 then a end) / sum(a), 8), sum(case when r <= 3 then a end) / sum(a) > 0.5 from pr
union all select 'FOLD_INSTABILITY', count(*) filter (where g > 0)::double, count(*) filter (where g > 0) < ceil(count(*) / 2.0) from ft
union all select 'BENCHMARK_UNDERPERFORMANCE', round(ln(1 + tr) - ln(1 + br), 8), tr < br from m""")
def finding_triggers(t):
    rows = [r.asDict() for r in _periods(t).select("exit", "gross_return", "turnover", "strategy_return", "benchmark_return").orderBy("exit").collect()]
    own = metrics.summary(_periods(t), 12.0).first()
    bench = _periods(t).where("benchmark_return is not null").agg((F.product(1 + F.col("benchmark_return")) - 1).alias("b")).first()["b"]
    parts = [r["c"] for r in _held(t).groupBy("symbol").agg(F.sum(F.col("weight") * F.col("period_return")).alias("c")).collect()]
    import math

    import numpy as np

    returns = np.array([r["strategy_return"] for r in rows])
    broken, leaked, cover = rules.price_breaks(t.prices).first()["n"], rules.leaks(t.leaky_features).first()["n"], rules.coverage(t.prices, "session").first()
    even, totals = rules.breakeven_bps(sum(r["gross_return"] for r in rows), sum(r["turnover"] for r in rows)), rules.fold_totals(returns, 4)
    symbols, periods = rules.top_share(parts), rules.top_share(returns)
    found = [
        ("DATA_PRICE_INVARIANT", broken, broken > 0),
        ("DATA_TEMPORAL_LEAK", leaked, leaked > 0),
        ("DATA_COVERAGE_UNEVEN", cover["least"], cover["uneven"]),
        ("PERFORMANCE_SAMPLE_SMALL", len(rows), len(rows) < 24),
        ("PERFORMANCE_EXTREME_SHARPE", round(own["sharpe"], 8), abs(own["sharpe"]) > 3),
        ("COST_FRAGILE", round(even, 6), even <= 1.5 * BPS),
        ("SYMBOL_CONCENTRATION", round(symbols, 8), symbols > 0.6),
        ("RETURN_CONCENTRATION", round(periods, 8), periods > 0.5),
        ("FOLD_INSTABILITY", sum(x > 0 for x in totals), rules.most_folds_lost(totals)),
        ("BENCHMARK_UNDERPERFORMANCE", round(math.log1p(own["total_return"]) - math.log1p(bench), 8), own["total_return"] < bench),
    ]
    return t.spark.createDataFrame([(c, float(m), bool(f)) for c, m, f in found], "code string, measured double, fires boolean")


@register("perturbed_facts", oracle_ctes("features", "known_events") + " select 'features' as kind, symbol, count(*) as n, round(sum(case when available_at > date '1996-01-01' then value * -7 else value end), 6) as total from features group by symbol union all select 'events', symbol, count(*), round(sum(case when available_at > date '2000-01-10' then 0 else cast(json_extract_string(payload, '$.k') as double) end), 6) from known_events group by symbol")
def perturbed_facts(t):
    b = _bundle(t)
    features = causality.perturbed(b, b.prices.sparkSession.sql("select timestamp'1996-01-01' as t").first()["t"]).features
    events = causality.perturbed(b, b.prices.sparkSession.sql("select timestamp'2000-01-10' as t").first()["t"]).events
    a = features.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("value_num"), 6).alias("total"))
    c = events.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce(F.get_json_object("payload", "$.k").cast("double"), F.lit(0.0))), 6).alias("total"))
    return a.select(F.lit("features").alias("kind"), "symbol", "n", "total").unionByName(c.select(F.lit("events").alias("kind"), "symbol", "n", "total"))


# -- providers ------------------------------------------------------------------------------

_SIX = "('BRAND#11', 'BRAND#12', 'BRAND#13')"


@register("provider_flatten", _P + f""", late as (select symbol, session, open, high, low, case when extract(day from session) = 5 then null else close + 1 end as close, case when extract(day from session) < 10 then null else volume end as volume, 2 as seq from prices where symbol in {_SIX} and extract(month from session) = 6),
al as (select symbol, session, open, high, low, close, volume, 1 as seq from prices where symbol in {_SIX} union all select * from late), ok as (select * from al where open is not null and high is not null and low is not null and close is not null)
select symbol, cast(session as varchar) as session, close, coalesce(volume, 0) as volume from (select *, row_number() over (partition by symbol, session order by seq desc) as k from ok) where k = 1""")
def provider_flatten(t):
    few = t.prices.where(F.col("symbol").isin("BRAND#11", "BRAND#12", "BRAND#13"))
    day = F.dayofmonth("session")
    late = few.where(F.month("session") == 6).withColumns({"close": F.when(day == 5, None).otherwise(F.col("close") + 1), "volume": F.when(day < 10, None).otherwise(F.col("volume"))})
    wide = None
    for seq, rows in ((1, few), (2, late)):
        cells = [F.max(F.when(F.col("symbol") == s, F.col(f))).alias(f"{s}|{f.title()}") for s in ("BRAND#11", "BRAND#12", "BRAND#13") for f in ("open", "high", "low", "close", "volume")]
        part = rows.groupBy(F.col("session").cast("timestamp").alias("timestamp")).agg(*cells).withColumn("ingest_seq", F.lit(seq))
        wide = part if wide is None else wide.unionByName(part)
    return provider.flatten(wide, "driver").select("symbol", F.to_date("timestamp").cast("string").alias("session"), "close", "volume")


@register("provider_universe", _P + " select symbol, cast(min(session) as varchar) as effective_from, cast(min(session) as varchar) as available_at from prices group by symbol")
def provider_universe(t):
    u = provider.synthesised_universe(t.prices.withColumnRenamed("session", "timestamp"), "driver")
    return u.select("symbol", *text("effective_from", "available_at"))


@register("schedule_bounds", _P + ", sess as (select session, lead(session) over (order by session) as execution from (select distinct session from prices)), b as (select * from sess where session between date '1994-05-10' and date '1995-08-16'), d as (select max(session) as decision from b group by date_trunc('month', session)) select cast(decision as varchar) as decision, cast(execution as varchar) as execution from d join sess on session = decision")
def schedule_bounds(t):
    return calendar.decisions(calendar.sessions(t.prices), "monthly", "1994-05-10", "1995-08-16").select(*text("decision", "execution"))

