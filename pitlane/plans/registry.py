"""Every registered query with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane.functions import metrics, panel, recursive
from pitlane.operators import asof, calendar, portfolio
from pitlane.sources.canonical import Tables, oracle_ctes

QUERIES: dict = {}
ORACLES: dict = {}
LOOKBACK, TOP, BPS, CAP, BENCHMARK = 8, 5, 15.0, 0.4, "BRAND#11"


_used: list[Tables] = []


def _tables(spark, sf_dir: str) -> Tables:
    """Tables for one query; those of the query before are released, so a long session doesn't fill up."""
    while _used:
        _used.pop().release()
    _used.append(Tables(spark, sf_dir))
    return _used[0]


def register(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(_tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return build

    return add


def text(*days: str) -> list:
    """Dates leave as text, so every client shows them alike."""
    return [F.col(d).cast("string").alias(d) for d in days]


def rounded(*names: str, digits: int = 8) -> list:
    return [F.round(n, digits).alias(n) for n in names]


# -- shared plans ---------------------------------------------------------------------------


def _calendar(t: Tables):
    return t.kept("_calendar", lambda: calendar.sessions(t.prices))


def _numbered(t: Tables):
    return calendar.numbered(t.prices, _calendar(t))


def _schedule(t: Tables, frequency: str = "monthly"):
    return t.kept(f"_schedule_{frequency}", lambda: calendar.decisions(_calendar(t), frequency))


def _momentum(t: Tables):
    return _numbered(t).withColumn("score", panel.change(LOOKBACK)).where("score is not null")


def _signals(t: Tables):
    return _momentum(t).join(F.broadcast(_schedule(t).select("decision")), F.col("session") == F.col("decision")).select("decision", "symbol", "score")


def _weighted(t: Tables, scheme: str = "equal"):
    return portfolio.weights(portfolio.top(_signals(t), TOP), scheme, CAP)


def _held(t: Tables):
    return t.kept("_held", lambda: portfolio.holdings(_weighted(t, "rank"), _schedule(t), t.prices))


def _benchmark(t: Tables, rows: DataFrame):
    own = t.prices.where(F.col("symbol") == BENCHMARK).select("session", "open")
    a, b = own.withColumnsRenamed({"session": "execution", "open": "b0"}), own.withColumnsRenamed({"session": "exit", "open": "b1"})
    return rows.join(F.broadcast(a), "execution", "left").join(F.broadcast(b), "exit", "left").withColumn("benchmark_return", F.when(F.col("b0") > 0, F.col("b1") / F.col("b0") - 1)).drop("b0", "b1")


def _periods(t: Tables):
    return _benchmark(t, portfolio.periods(_held(t), _schedule(t), BPS))


_SESS = ", sess as (select session, row_number() over (order by session) as n from (select distinct session from prices))"
_PX = _SESS + ", px as (select p.*, s.n from prices p join sess s using (session))"
_DEC = ", nxt as (select *, lead(session) over (order by session) as execution from sess), dec0 as (select max(session) as decision from nxt group by {period}), dec as (select decision, n, execution, lead(execution) over (order by decision) as exit from dec0 join nxt on session = decision)"
_MONTHLY = _DEC.format(period="date_trunc('month', session)")
_WEEKLY = _DEC.format(period="date_trunc('week', session + interval 2 day)")
_SIG = _PX + _MONTHLY + f", mom as (select a.symbol, a.session, a.close / b.close - 1 as score from px a join px b on a.symbol = b.symbol and b.n = a.n - {LOOKBACK}), sig as (select decision, symbol, score from mom join dec on session = decision)"
_TOP = _SIG + f", pick as (select * from (select *, row_number() over (partition by decision order by score desc, symbol) as position from sig) where position <= {TOP})"
_WT = _TOP + f""", w as (select *, least({CAP}, 1.0 / count(*) over (partition by decision)) as equal_w,
  least({CAP}, (count(*) over (partition by decision) - position + 1)::double / sum(position) over (partition by decision)) as rank_w,
  least({CAP}, (score - min(score) over (partition by decision) + 1e-12) / sum(score - mn + 1e-12) over (partition by decision)) as score_w from (select *, min(score) over (partition by decision) as mn from pick))"""
_HELD = _WT + """, held as (select w.decision, d.execution, d.exit, w.symbol, w.score, w.rank_w as weight, b.open / a.open - 1 as period_return
  from w join dec d using (decision) join prices a on a.symbol = w.symbol and a.session = d.execution join prices b on b.symbol = w.symbol and b.session = d.exit where d.exit is not null and a.open > 0 and b.open > 0)"""
_DRIFT = _HELD + """, tot as (select decision, greatest(0.0, 1 - sum(weight)) + sum(weight * (1 + period_return)) as total from held group by decision),
drift as (select decision, symbol, weight * (1 + period_return) / total as drifted from held join tot using (decision) where total > 0 and weight * (1 + period_return) / total > 0)"""
_TURN = _DRIFT + """, ord as (select decision, lag(decision) over (order by decision) as before from dec where exit is not null),
book as (select coalesce(a.decision, b.decision) as decision, coalesce(a.weight, 0) as nw, coalesce(b.drifted, 0) as ow from held a full outer join (select o.decision, d.symbol, d.drifted from drift d join ord o on o.before = d.decision) b on a.decision = b.decision and a.symbol = b.symbol),
turn as (select decision, 0.5 * (sum(abs(nw - ow)) + abs(sum(ow) - sum(nw))) as turnover from book group by decision)"""
_PER = _TURN + f""", per as (select d.decision, d.execution, d.exit, coalesce(g.gross, 0) as gross_return, coalesce(t.turnover, 0) as turnover, coalesce(t.turnover, 0) * {BPS} / 1e4 as cost,
  coalesce(g.gross, 0) - coalesce(t.turnover, 0) * {BPS} / 1e4 as strategy_return, coalesce(g.c, 0) as holdings_count, coalesce(g.w, 0) as gross_exposure, case when a.open > 0 then b.open / a.open - 1 end as benchmark_return
  from dec d left join (select decision, sum(weight * period_return) as gross, count(*) as c, sum(weight) as w from held group by decision) g using (decision) left join turn t using (decision)
  left join prices a on a.symbol = '{BENCHMARK}' and a.session = d.execution left join prices b on b.symbol = '{BENCHMARK}' and b.session = d.exit where d.exit is not null)"""
_P = oracle_ctes("prices")

# -- normalisation, visibility, membership --------------------------------------------------

_AT = _SESS + _MONTHLY + ", asked as (select decision as t from dec)"


def _at(t: Tables):
    return _schedule(t).select(F.col("decision").alias("t"))


@register("asof_prices", _P + _AT + " select cast(t as varchar) as t, symbol, cast(max(session) as varchar) as session, max_by(close, session) as close from asked join prices on session <= t group by t, symbol")
def asof_prices(t):
    return asof.latest_prices(t.prices, _at(t)).select(*text("t"), "symbol", *text("session"), "close")


@register("asof_features_latest", oracle_ctes("prices", "features") + _AT + """ select cast(t as varchar) as t, symbol, feature, cast(observed_at as varchar) as observed_at, cast(available_at as varchar) as available_at, revision, value from (
  select *, row_number() over (partition by t, symbol, feature order by observed_at desc, available_at desc, revision desc) as k from asked join features on available_at <= t and observed_at <= t) where k = 1""")
def asof_features_latest(t):
    return asof.latest_features(t.features, _at(t)).select(*text("t"), "symbol", "feature", *text("observed_at", "available_at"), "revision", "value")


_EVENT_DAYS = ", asked as (select distinct event_at as t from known_events)"


def _event_days(t):
    return t.events.select(F.col("event_at").alias("t")).distinct()


@register("asof_events_known", oracle_ctes("known_events") + _EVENT_DAYS + " select cast(t as varchar) as t, symbol, event_type, count(*) as n from asked join known_events on available_at <= t and event_at <= t and event_at >= t - 10 group by all")
def asof_events_known(t):
    return asof.known_events(t.events, _event_days(t), days=10).groupBy(*text("t"), "symbol", "event_type").agg(F.count("*").alias("n"))


@register("event_sentiment", oracle_ctes("known_events") + _EVENT_DAYS + " select cast(t as varchar) as t, symbol, round(avg(coalesce((cast(json_extract_string(payload, '$.k') as double) - 50) / 50, 0)), 8) + 0.0 as sentiment from asked join known_events on available_at <= t and event_at <= t and event_at >= t - 10 group by all")
def event_sentiment(t):
    value = F.coalesce((F.get_json_object("payload", "$.k").cast("double") - 50) / 50, F.lit(0.0))
    return asof.known_events(t.events, _event_days(t), days=10).groupBy(*text("t"), "symbol").agg((F.round(F.avg(value), 8) + 0.0).alias("sentiment"))


@register("universe_at_dates", oracle_ctes("prices", "universe") + _AT + " select distinct cast(t as varchar) as t, symbol from asked join universe on available_at <= t and effective_from <= t and (effective_to is null or effective_to > t)")
def universe_at_dates(t):
    return asof.members(t.universe, _at(t)).select(*text("t"), "symbol")


@register("universe_fallback_latest_session", _P + _AT + " select distinct cast(t as varchar) as t, symbol from (select t, max(session) as session from asked join prices on session <= t group by t) join prices using (session)")
def universe_fallback(t):
    return asof.members_without_universe(t.prices, _at(t)).select(*text("t"), "symbol")


@register("symbols_union", oracle_ctes("prices", "features", "known_events", "universe") + " select symbol from prices union select symbol from features union select symbol from known_events union select symbol from universe")
def symbols_union(t):
    return t.prices.select("symbol").union(t.features.select("symbol")).union(t.events.select("symbol")).union(t.universe.select("symbol")).distinct()


@register("set_ops", oracle_ctes("prices", "nation_prices", "universe") + " select 'only_priced' as kind, symbol from (select symbol from nation_prices except select symbol from universe) union all select 'both', symbol from (select symbol from prices intersect select symbol from universe where effective_to is null)")
def set_ops(t):
    left = t.nation_prices.select("symbol").distinct().join(t.universe.select("symbol"), "symbol", "left_anti")
    both = t.prices.select("symbol").distinct().join(t.universe.where("effective_to is null").select("symbol"), "symbol", "left_semi")
    return left.select(F.lit("only_priced").alias("kind"), "symbol").unionByName(both.select(F.lit("both").alias("kind"), "symbol"))


@register("data_invariants", _P + " select count(*) as n, count(*) filter (where high < greatest(open, close, low)) as high_low, count(*) filter (where low > least(open, close, high)) as low_high, count(*) filter (where least(open, high, low, close) <= 0) as not_positive, count(*) filter (where volume < 0) as negative_volume from prices")
def data_invariants(t):
    n = lambda c: F.count(F.when(c, 1))
    return t.prices.agg(F.count("*").alias("n"), n(F.col("high") < F.greatest("open", "close", "low")).alias("high_low"), n(F.col("low") > F.least("open", "close", "high")).alias("low_high"), n(F.least("open", "high", "low", "close") <= 0).alias("not_positive"), n(F.col("volume") < 0).alias("negative_volume"))


@register("temporal_leaks", oracle_ctes("leaky") + " select symbol, count(*) as n, cast(min(available_at) as varchar) as first from leaky where available_at < observed_at group by symbol")
def temporal_leaks(t):
    return t.leaky_features.where("available_at < observed_at").groupBy("symbol").agg(F.count("*").alias("n"), F.min("available_at").cast("string").alias("first"))


@register("duplicate_keys", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_keys(t):
    rows = t.spark.read.parquet(f"{t.path}/lineitem.parquet")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@register("coverage_uneven", oracle_ctes("nation_prices") + ", c as (select symbol, count(distinct session) as k from nation_prices group by symbol) select min(k) as least, median(k) as middle, min(k) < greatest(20, cast(floor(median(k) * 0.5) as bigint)) as uneven from c")
def coverage_uneven(t):
    c = t.nation_prices.groupBy("symbol").agg(F.countDistinct("session").alias("k"))
    return c.agg(F.min("k").alias("least"), F.median("k").alias("middle")).withColumn("uneven", F.col("least") < F.greatest(F.lit(20), F.floor(F.col("middle") * 0.5)))


@register("history_counts", _P + _SESS + _MONTHLY + " select cast(decision as varchar) as decision, symbol, count(*) as sessions from dec join prices on session <= decision group by all")
def history_counts(t):
    order = Window.partitionBy("symbol").orderBy("session")
    runs = t.prices.select("symbol", F.col("session"), F.row_number().over(order).cast("double").alias("close"))
    at = asof.latest_prices(runs, _at(t))
    return at.select(F.col("t").cast("string").alias("decision"), "symbol", F.col("close").cast("long").alias("sessions"))


@register("describe_tables", oracle_ctes("prices", "features", "known_events", "universe") + " select 'prices' as name, count(*) as n, cast(min(session) as varchar) as first, cast(max(session) as varchar) as last from prices union all select 'features', count(*), cast(min(observed_at) as varchar), cast(max(observed_at) as varchar) from features union all select 'events', count(*), cast(min(event_at) as varchar), cast(max(event_at) as varchar) from known_events union all select 'universe', count(*), cast(min(effective_from) as varchar), cast(max(effective_from) as varchar) from universe")
def describe_tables(t):
    one = lambda name, df, day: df.agg(F.count("*").alias("n"), F.min(day).cast("string").alias("first"), F.max(day).cast("string").alias("last")).select(F.lit(name).alias("name"), "n", "first", "last")
    return one("prices", t.prices, "session").union(one("features", t.features, "observed_at")).union(one("events", t.events, "event_at")).union(one("universe", t.universe, "effective_from"))


# -- schedules ------------------------------------------------------------------------------

_SHOW = " select cast(decision as varchar) as decision, cast(execution as varchar) as execution, cast(exit as varchar) as exit from dec"


@register("decisions_monthly", _P + _SESS + _MONTHLY + _SHOW)
def decisions_monthly(t):
    return _schedule(t).select(*text("decision", "execution", "exit"))


@register("decisions_weekly", oracle_ctes("nation_prices") + _SESS.replace("from prices", "from nation_prices") + _WEEKLY + _SHOW)
def decisions_weekly(t):
    return calendar.decisions(calendar.sessions(t.nation_prices), "weekly").select(*text("decision", "execution", "exit"))


@register("next_session", _P + _SESS + " select cast(session as varchar) as session, cast(lead(session) over (order by session) as varchar) as following from sess")
def next_session(t):
    return _calendar(t).select(F.col("session").cast("string").alias("session"), F.lead("session").over(Window.orderBy("session")).cast("string").alias("following"))


# -- technical columns ----------------------------------------------------------------------


@register("returns_1d", _P + _PX + " select a.symbol, cast(a.session as varchar) as session, a.close / b.close - 1 as ret from px a left join px b on a.symbol = b.symbol and b.n = a.n - 1")
def returns_1d(t):
    return _numbered(t).select("symbol", *text("session"), panel.change(1).alias("ret"))


@register("sma", _P + _PX + " select symbol, cast(session as varchar) as session, round(case when count(close) over f = 10 then avg(close) over f end, 8) as sma from px window f as (partition by symbol order by n range between 9 preceding and current row)")
def sma(t):
    return _numbered(t).select("symbol", *text("session"), F.round(panel.sma(10), 8).alias("sma"))


_RET = _PX + ", rets as (select a.symbol, a.session, a.n, a.close / b.close - 1 as ret from px a left join px b on a.symbol = b.symbol and b.n = a.n - 1)"


@register("volatility", _P + _RET + " select symbol, cast(session as varchar) as session, round(case when count(ret) over f = 12 then stddev_samp(ret) over f end * sqrt(52.0), 8) as volatility from rets window f as (partition by symbol order by n range between 11 preceding and current row)")
def volatility(t):
    return panel.with_volatility(_numbered(t), 12).select("symbol", *text("session"), *rounded("volatility"))


@register("momentum", _P + _SIG + " select cast(session as varchar) as session, symbol, score from mom")
def momentum(t):
    return _momentum(t).select(*text("session"), "symbol", "score")


_RANK = "(rank() over (partition by {d} order by {v}) + (count(*) over (partition by {d}, {v}) - 1) / 2) / count({v}) over (partition by {d})"


@register("xs_rank_pct", _P + _SIG + f" select cast(session as varchar) as session, symbol, case when count(*) over (partition by session) = 1 then 0.5 else {_RANK.format(d='session', v='score')} end as pct from mom")
def xs_rank_pct(t):
    return _momentum(t).select(*text("session"), "symbol", panel.pct_rank("score", ["session"], True).alias("pct"))


@register("winsorize", _P + _SIG + " select cast(session as varchar) as session, symbol, round(least(greatest(score, lo), hi), 8) as score from mom join (select session, quantile_cont(score, 0.1) as lo, quantile_cont(score, 0.9) as hi from mom group by session) using (session)")
def winsorize(t):
    return panel.winsorized(_momentum(t).select("session", "symbol", "score"), "score", ["session"], 0.1, 0.9).select(*text("session"), "symbol", *rounded("score"))


_COMBO = oracle_ctes("prices", "features") + _SIG + """, lat as (select decision, symbol, value from (select decision, f.symbol, f.value, row_number() over (partition by decision, f.symbol order by observed_at desc, available_at desc, revision desc) as k from dec join features f on available_at <= decision and observed_at <= decision) where k = 1),
paired as (select coalesce(a.decision, b.decision) as decision, coalesce(a.symbol, b.symbol) as symbol, a.score as m, b.value as v from sig a full outer join lat b on a.decision = b.decision and a.symbol = b.symbol),
ranked as (select decision, symbol, case when m is not null then (rank() over (partition by decision order by m nulls last) + (count(m) over (partition by decision, m) - 1) / 2) / count(m) over (partition by decision) end as mr,
  case when v is not null then (rank() over (partition by decision order by v nulls last) + (count(v) over (partition by decision, v) - 1) / 2) / count(v) over (partition by decision) end as vr from paired),
comb as (select decision, symbol, (coalesce(0.6 * mr, 0) + coalesce(0.4 * vr, 0)) / nullif(case when mr is null then 0 else 0.6 end + case when vr is null then 0 else 0.4 end, 0) as score from ranked)"""


def _combined(t):
    lat = asof.latest_features(t.features, _at(t)).select(F.col("t").alias("decision"), "symbol", F.col("value").alias("v"))
    both = _signals(t).withColumnRenamed("score", "m").join(lat, ["decision", "symbol"], "full_outer")
    ranked = both.select("decision", "symbol", panel.pct_rank("m", ["decision"]).alias("mr"), panel.pct_rank("v", ["decision"]).alias("vr"))
    return ranked.select("decision", "symbol", panel.combined([("mr", 0.6), ("vr", 0.4)]).alias("score"))


@register("combine_ranks", _COMBO + " select cast(decision as varchar) as decision, symbol, round(score, 8) as score from comb")
def combine_ranks(t):
    return _combined(t).select(*text("decision"), "symbol", *rounded("score"))


@register("composite_topk", _COMBO + " select cast(decision as varchar) as decision, symbol, position from (select decision, symbol, row_number() over (partition by decision order by round(score, 8) desc, symbol) as position from comb) where position <= 3")
def composite_topk(t):
    return portfolio.top(_combined(t).withColumn("score", F.round("score", 8)), 3).select(*text("decision"), "symbol", "position")


# -- portfolios -----------------------------------------------------------------------------
# Brand-week prices jump wildly, so growth over many periods is given as a logarithm.


@register("screen_topk", _P + _TOP + " select symbol, score, position as rank from pick where decision = (select max(decision) from sig)")
def screen_topk(t):
    signals = _signals(t)
    last = signals.agg(F.max("decision").alias("decision"))
    return portfolio.top(signals.join(F.broadcast(last), "decision"), TOP).select("symbol", "score", F.col("position").alias("rank"))


for _scheme in ("equal", "rank", "score"):

    @register(f"weights_{_scheme}", _P + _WT + f" select cast(decision as varchar) as decision, symbol, round({_scheme}_w, 8) as weight from w")
    def _weights(t, scheme=_scheme):
        return _weighted(t, scheme).select(*text("decision"), "symbol", *rounded("weight"))


@register("holdings_returns", _P + _HELD + " select cast(decision as varchar) as decision, cast(execution as varchar) as execution, cast(exit as varchar) as exit, symbol, round(weight, 8) as weight, period_return from held")
def holdings_returns(t):
    return _held(t).select(*text("decision", "execution", "exit"), "symbol", *rounded("weight"), "period_return")


@register("drifted_weights", _P + _DRIFT + " select cast(decision as varchar) as decision, symbol, round(drifted, 8) as drifted from drift")
def drifted_weights(t):
    return portfolio.drifted(_held(t)).select(*text("decision"), "symbol", *rounded("drifted"))


@register("turnover", _P + _TURN + " select cast(decision as varchar) as decision, round(turnover, 8) as turnover from turn")
def turnover(t):
    return portfolio.turnover(_held(t), _schedule(t)).select(*text("decision"), *rounded("turnover"))


_NUMBERS = ("gross_return", "turnover", "cost", "strategy_return", "gross_exposure", "benchmark_return")


@register("period_returns_net", _P + _PER + " select cast(decision as varchar) as decision, cast(execution as varchar) as execution, cast(exit as varchar) as exit, holdings_count, " + ", ".join(f"round({c}, 8) as {c}" for c in _NUMBERS) + " from per")
def period_returns_net(t):
    return _periods(t).select(*text("decision", "execution", "exit"), "holdings_count", *rounded(*_NUMBERS))


@register("cost_curve", _P + _PER + " select m as multiplier, round(ln(product(1 + gross_return - cost * m)), 8) as log_growth, round(sum(cost * m), 8) as total_cost from per, (values (0.0::double), (1.0), (2.0), (5.0)) c(m) group by m")
def cost_curve(t):
    grid = _periods(t).withColumn("multiplier", F.explode(F.array(*(F.lit(m) for m in (0.0, 1.0, 2.0, 5.0)))))
    return grid.groupBy("multiplier").agg(F.round(F.log(F.product(1 + F.col("gross_return") - F.col("cost") * F.col("multiplier"))), 8).alias("log_growth"), F.round(F.sum(F.col("cost") * F.col("multiplier")), 8).alias("total_cost"))


_EQ = _PER + ", eq as (select exit, product(1 + strategy_return) over (order by exit) as equity from per), dd as (select *, equity / max(equity) over (order by exit) - 1 as drawdown from eq)"


@register("equity_curve", _P + _EQ + " select cast(exit as varchar) as exit, round(ln(equity), 8) as log_equity, round(drawdown, 8) as drawdown from dd")
def equity_curve(t):
    return portfolio.equity(_periods(t)).withColumn("log_equity", F.log("equity")).select(*text("exit"), *rounded("log_equity", "drawdown"))


@register("drawdown", _P + _EQ + " select round(min(drawdown), 8) as max_drawdown from dd")
def drawdown(t):
    return portfolio.equity(_periods(t)).agg(F.round(F.min("drawdown"), 8).alias("max_drawdown"))


@register("metrics_core", _P + _PER + """ select periods, round(ln(1 + tr), 8) as log_growth, round(case when tr <= -1 then -1.0 else pow(1 + tr, 12.0 / periods) - 1 end, 8) as annual_return, round(vol, 8) as annual_volatility,
  round(case when vol > 0 then mean * 12 / vol end, 8) as sharpe, round(case when down > 0 then mean * 12 / down end, 8) as sortino, round(win_rate, 8) as win_rate, round(best, 8) as best, round(worst, 8) as worst from (
  select count(*) as periods, product(1 + strategy_return) - 1 as tr, coalesce(stddev_samp(strategy_return), 0) * sqrt(12.0) as vol, avg(strategy_return) as mean, coalesce(stddev_samp(case when strategy_return < 0 then strategy_return end), 0) * sqrt(12.0) as down,
  avg((strategy_return > 0)::double) as win_rate, max(strategy_return) as best, min(strategy_return) as worst from per)""")
def metrics_core(t):
    out = metrics.core(_periods(t), 12.0)
    return out.withColumn("log_growth", F.log1p("total_return")).select("periods", *rounded("log_growth", *out.columns[2:]))


@register("metrics_tail", _P + _PER + ", v as (select quantile_cont(strategy_return, 0.05) as var_95 from per) select round(var_95, 8) as var_95, round(avg(strategy_return), 8) as cvar_95 from per join v on strategy_return <= var_95 group by var_95")
def metrics_tail(t):
    return metrics.tail(_periods(t)).select(*rounded("var_95", "cvar_95"))


@register("metrics_moments", _P + _PER + " select round(skewness(strategy_return), 7) as skew, round(kurtosis(strategy_return), 7) as excess_kurtosis from per")
def metrics_moments(t):
    return metrics.moments(_periods(t)).select(*rounded("skew", "excess_kurtosis", digits=7))


@register("metrics_benchmark", _P + _PER + """ select round(cov / var, 8) as beta, round((ms - cov / var * mb) * 12, 8) as annual_alpha, round((ms - mb) / sd * sqrt(12.0), 8) as information_ratio, round(c, 8) as correlation from (
  select covar_samp(strategy_return, benchmark_return) as cov, var_samp(benchmark_return) as var, corr(strategy_return, benchmark_return) as c, avg(strategy_return) as ms, avg(benchmark_return) as mb, stddev_samp(strategy_return - benchmark_return) as sd from per where benchmark_return is not null)""")
def metrics_benchmark(t):
    return metrics.against_benchmark(_periods(t), 12.0).select(*rounded("beta", "annual_alpha", "information_ratio", "correlation"))


@register("benchmark_returns", _P + _PER + " select cast(exit as varchar) as exit, benchmark_return from per")
def benchmark_returns(t):
    return _benchmark(t, _schedule(t).where("exit is not null")).select(*text("exit"), "benchmark_return")


@register("fold_returns", _P + _PER + " select fold, count(*) as periods, round(ln(product(1 + strategy_return)), 8) as log_growth from (select ntile(4) over (order by exit) as fold, strategy_return from per) group by fold")
def fold_returns(t):
    return _periods(t).withColumn("fold", F.ntile(4).over(Window.orderBy("exit"))).groupBy("fold").agg(F.count("*").alias("periods"), F.round(F.log(F.product(1 + F.col("strategy_return"))), 8).alias("log_growth"))


@register("regime_returns", _P + _PER + """, vol as (select exit, strategy_return, benchmark_return, case when count(*) over f >= 2 then stddev_samp(benchmark_return) over f end as v from per where benchmark_return is not null window f as (order by exit rows between 3 preceding and current row)),
lab as (select *, case when v > (select median(v) from vol) then 'high_vol' when benchmark_return >= 0 then 'up' else 'down' end as regime from vol) select regime, count(*) as periods, round(ln(product(1 + strategy_return)), 8) as log_growth from lab group by regime""")
def regime_returns(t):
    frame = Window.orderBy("exit").rowsBetween(-3, 0)
    rows = _periods(t).where("benchmark_return is not null").withColumn("v", F.when(F.count("*").over(frame) >= 2, F.stddev_samp("benchmark_return").over(frame)))
    rows = rows.withColumn("threshold", F.median("v").over(Window.partitionBy()))
    regime = F.when(F.col("v") > F.col("threshold"), "high_vol").when(F.col("benchmark_return") >= 0, "up").otherwise("down")
    return rows.groupBy(regime.alias("regime")).agg(F.count("*").alias("periods"), F.round(F.log(F.product(1 + F.col("strategy_return"))), 8).alias("log_growth"))


@register("symbol_concentration", _P + _HELD + ", s as (select symbol, abs(sum(weight * period_return)) as c from held group by symbol), r as (select *, row_number() over (order by round(c, 8) desc, symbol) as k, sum(c) over () as total from s) select symbol, round(c / total, 8) as share from r where k <= 3")
def symbol_concentration(t):
    s = _held(t).groupBy("symbol").agg(F.abs(F.sum(F.col("weight") * F.col("period_return"))).alias("c"))
    r = s.withColumns({"k": F.row_number().over(Window.orderBy(F.round("c", 8).desc(), "symbol")), "total": F.sum("c").over(Window.partitionBy())})
    return r.where("k <= 3").select("symbol", F.round(F.col("c") / F.col("total"), 8).alias("share"))


@register("period_concentration", _P + _PER + " select round(sum(case when k <= 3 then a end) / sum(a), 8) as share from (select abs(strategy_return) as a, row_number() over (order by abs(strategy_return) desc) as k from per)")
def period_concentration(t):
    a = _periods(t).select(F.abs("strategy_return").alias("a"))
    a = a.withColumn("k", F.row_number().over(Window.orderBy(F.desc("a"))))
    return a.agg(F.round(F.sum(F.when(F.col("k") <= 3, F.col("a"))) / F.sum("a"), 8).alias("share"))


@register("breakeven_cost", _P + _PER + " select round(sum(gross_return) / nullif(sum(turnover), 0) * 1e4, 6) as breakeven_bps from per")
def breakeven_cost(t):
    return _periods(t).agg(F.round(F.try_divide(F.sum("gross_return"), F.sum("turnover")) * 1e4, 6).alias("breakeven_bps"))


_TRAIN, _TEST = 12, 6


@register("walkforward_folds", _P + _PER + f""", num as (select *, row_number() over (order by exit) as i from per), f as (select unnest(range(0, (select max(i) from num) - {_TRAIN + _TEST} + 1, {_TEST})) as s)
select cast(s / {_TEST} as bigint) as fold, round(ln(product(case when i <= s + {_TRAIN} then 1 + gross_return end)), 8) as train_growth, round(ln(product(case when i > s + {_TRAIN} then 1 + gross_return end)), 8) as test_growth from f join num on i > s and i <= s + {_TRAIN + _TEST} group by s""")
def walkforward_folds(t):
    num = _periods(t).select("gross_return", F.row_number().over(Window.orderBy("exit")).alias("i"))
    last = num.withColumn("last", F.max("i").over(Window.partitionBy()))
    # a period belongs to every fold whose window holds it, so folds come from an explode instead of a join
    fold = F.sequence(F.lit(0), F.floor((F.col("last") - _TRAIN - _TEST) / _TEST).cast("int"))
    rows = last.where(F.col("last") >= _TRAIN + _TEST).select("i", "gross_return", F.explode(fold).alias("fold")).withColumn("at", F.col("i") - F.col("fold") * _TEST).where((F.col("at") > 0) & (F.col("at") <= _TRAIN + _TEST))
    part = lambda c: F.round(F.log(F.product(F.when(c, 1 + F.col("gross_return")))), 8)
    return rows.groupBy(F.col("fold").cast("long").alias("fold")).agg(part(F.col("at") <= _TRAIN).alias("train_growth"), part(F.col("at") > _TRAIN).alias("test_growth"))


@register("future_perturbation", _P + " select symbol, cast(session as varchar) as session, case when session > date '1997-01-06' then close * (1.5 + (row_number() over (partition by session > date '1997-01-06' order by session, symbol) - 1) / count(*) over (partition by session > date '1997-01-06')) else close end as close, case when session > date '1997-01-06' then volume * 3 else volume end as volume from prices")
def future_perturbation(t):
    changed = asof.perturbed(t.prices, F.lit("1997-01-06").cast("date"))
    return changed.select("symbol", *text("session"), "close", "volume")


# -- exponential averages -------------------------------------------------------------------

_DENSE = _PX + """, span as (select symbol, min(n) as a, max(n) as b from px group by symbol), grid as (select span.symbol, g.n from span join sess g on g.n between a and b),
den as (select grid.symbol, grid.n, px.close, row_number() over (partition by grid.symbol order by grid.n) as i from grid left join px on px.symbol = grid.symbol and px.n = grid.n)"""


def _recurrence(name: str, value: str, source: str, alpha: str) -> str:
    """(symbol, i, top, weight, seen) of the decayed mean (top) of `value`, one step a session: its weight decays over gaps and is 1 again after each value."""
    old = f"r.weight * (1 - {alpha})"
    return f"""{name} as (select symbol, i, coalesce({value}, 0)::double as top, case when {value} is null then 0.0 else 1.0 end::double as weight, case when {value} is null then 0 else 1 end as seen from {source} where i = 1
  union all select d.symbol, d.i, case when d.{value} is null then r.top when r.seen = 0 then d.{value} else ({old} * r.top + {alpha} * d.{value}) / ({old} + {alpha}) end,
  case when d.{value} is null then {old} else 1.0 end, r.seen + case when d.{value} is null then 0 else 1 end
  from {name} r join {source} d on d.symbol = r.symbol and d.i = r.i + 1)"""


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


@register("ema", _recursive(_P + _DENSE + ", " + _recurrence("r", "close", "den", "(2.0 / 11)") + " select den.symbol, cast(session as varchar) as session, round(case when seen >= 10 then top end, 6) as ema from den join r on r.symbol = den.symbol and r.i = den.i join sess on sess.n = den.n where close is not null"))
def ema(t):
    return recursive.ema(_numbered(t), 10).select("symbol", *text("session"), F.round(F.nanvl("ema", F.lit(None).cast("double")), 6).alias("ema"))


@register("rsi", _recursive(_P + _DENSE + ", st as (select symbol, i, n, close, close - lag(close) over (partition by symbol order by i) as d from den), ud as (select symbol, i, n, close, case when d is not null then greatest(d, 0) end as up, case when d is not null then greatest(-d, 0) end as down from st), " + _recurrence("u", "up", "ud", "(1.0 / 14)") + ", " + _recurrence("v", "down", "ud", "(1.0 / 14)") + " select ud.symbol, cast(session as varchar) as session, round(case when u.seen >= 14 and v.top > 0 then 100 - 100 / (1 + u.top / v.top) end, 6) as rsi from ud join u on u.symbol = ud.symbol and u.i = ud.i join v on v.symbol = ud.symbol and v.i = ud.i join sess on sess.n = ud.n where close is not null"))
def rsi(t):
    return recursive.rsi(_numbered(t)).select("symbol", *text("session"), F.round(F.nanvl("rsi", F.lit(None).cast("double")), 6).alias("rsi"))
