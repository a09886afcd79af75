"""The canonical research tables over the driver's tables.

The view text is valid in Spark and in DuckDB; {name} stands for a source table. Dates are DATE, and
every first/last is decided by a total order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: Brand-week prices: one session a week, some cells missing at small scale.
PRICES = """
select symbol, session, min_by(price, ord) as open, max(price) as high, min(price) as low, max_by(price, ord) as close, sum(qty) as volume from (
  select upper(trim(p.p_brand)) as symbol, cast(date_trunc('week', l.l_shipdate) as date) as session, l.l_extendedprice / l.l_quantity as price, l.l_quantity as qty,
    (l.l_shipdate, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_quantity) as ord
  from {lineitem} l join {part} p on l.l_partkey = p.p_partkey) x
group by symbol, session"""

#: Nation-day prices: sparse sessions, weekends included.
NATION_PRICES = """
select symbol, session, min_by(price, ord) as open, max(price) as high, min(price) as low, max_by(price, ord) as close, cast(count(*) as double) as volume from (
  select upper(n.n_name) as symbol, cast(o.o_orderdate as date) as session, o.o_totalprice as price, (o.o_orderdate, o.o_orderkey) as ord
  from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey) x
group by symbol, session"""

_FEATURES = """
select symbol, observed_at, available_at, feature, revision, max(value) as value from (
  select upper(trim(p.p_brand)) as symbol, cast(o.o_orderdate as date) as observed_at, {available} as available_at, 'discount' as feature, l.l_linenumber as revision, l.l_discount as value
  from {{lineitem}} l join {{orders}} o on l.l_orderkey = o.o_orderkey join {{part}} p on l.l_partkey = p.p_partkey) x
group by symbol, observed_at, available_at, feature, revision"""
FEATURES = _FEATURES.format(available="greatest(cast(o.o_orderdate as date), cast(l.l_shipdate as date))")
#: As delivered: half the rows were "available" before they were observed.
LEAKY_FEATURES = _FEATURES.format(available="cast(l.l_shipdate as date)")

EVENTS = """
select concat('BRAND#', cast(10 * (1 + user_id % 5) + 1 + cast(floor(user_id / 5) as bigint) % 5 as varchar(10))) as symbol, cast(ts - interval '24' year as date) as event_at,
  cast(ts - interval '24' year as date) + cast(event_id % 5 as int) as available_at, event_type, props as payload, event_id
from {events}"""

UNIVERSE = """
select symbol, cast('1995-01-01' as date) + cast(30 * (k % 10) as int) as effective_from,
  case when k % 4 = 0 then cast('1997-01-01' as date) + cast(30 * k as int) end as effective_to,
  cast('1995-01-01' as date) + cast(30 * (k % 10) as int) as available_at
from (select symbol, cast(substring(symbol, 7) as int) as k from (select distinct upper(trim(p_brand)) as symbol from {part}) b) u"""

_SOURCES = ("lineitem", "part", "orders", "customer", "nation", "events")


def oracle_ctes(*names: str) -> str:
    """`with a as (...), b as (...)` of the named views for DuckDB."""
    texts = {"prices": PRICES, "nation_prices": NATION_PRICES, "features": FEATURES, "leaky": LEAKY_FEATURES, "known_events": EVENTS, "universe": UNIVERSE}
    own = {s: s for s in _SOURCES}
    return "with " + ", ".join(f"{n} as ({texts[n].format(**own)})" for n in names)


@dataclass(frozen=True)
class Tables:
    """Lazily read canonical tables of one directory."""

    spark: SparkSession
    path: str

    def kept(self, name: str, build) -> DataFrame:
        """build(), made once for this object and kept: for small tables that a plan reads many times."""
        if name not in self.__dict__:
            self.__dict__[name] = build().persist()
        return self.__dict__[name]

    def release(self) -> None:
        """Give up what is kept; a plan that still uses it computes it again."""
        for x in (*self.__dict__.values(), *self.more):
            if isinstance(x, DataFrame):
                x.unpersist()

    @cached_property
    def more(self) -> list[DataFrame]:
        """What plans over these tables keep besides."""
        return []

    def _sql(self, text: str) -> DataFrame:
        used = {s: self.spark.read.parquet(f"{self.path}/{s}.parquet") for s in _SOURCES if "{" + s + "}" in text}
        return self.spark.sql(text, **used)

    @cached_property
    def prices(self) -> DataFrame:
        """Kept in memory or on disk once built: a backtest reads it for sessions, lookbacks, entries, exits and the benchmark, and it is far smaller than the lines it comes from."""
        return self._sql(PRICES).persist()

    @property
    def nation_prices(self) -> DataFrame:
        return self._sql(NATION_PRICES)

    @property
    def features(self) -> DataFrame:
        return self._sql(FEATURES)

    @property
    def leaky_features(self) -> DataFrame:
        return self._sql(LEAKY_FEATURES)

    @property
    def events(self) -> DataFrame:
        return self._sql(EVENTS)

    @property
    def universe(self) -> DataFrame:
        return self._sql(UNIVERSE)
