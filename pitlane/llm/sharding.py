"""Byte-balanced sharding by histogram sort.

Splitters are found by counting exact bytes below candidate keys. Each round sends one row per
candidate cell to the driver (their number depends on the shard count only), narrows every open
bracket to the cell that holds its target and to the keys seen in it, and ends when each shard
boundary is within tolerance or its bracket holds a single key. The rows then move once.

Only DataFrame functions run on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane.llm.common import long_array, rank_in, spool

_HALF = 1 << 63
_WORD = 1 << 64


@dataclass
class _Open:
    """A boundary's bracket: keys lo <= boundary <= hi with the bytes and rows below each."""

    target: float
    slack: float
    lo: int
    hi: int
    lo_bytes: int
    lo_rows: int
    hi_bytes: int
    hi_rows: int

    def done(self) -> bool:
        return self.hi - self.lo <= 1 or min(self.target - self.lo_bytes, self.hi_bytes - self.target) <= self.slack

    def best(self) -> tuple[int, int]:
        return (self.lo, self.lo_rows) if self.target - self.lo_bytes <= self.hi_bytes - self.target else (self.hi, self.hi_rows)


def _words(key: int) -> tuple[int, int]:
    key = min(key, _WORD * _WORD - 1)
    return key // _WORD - _HALF, key % _WORD - _HALF


def _key(row) -> int:
    return (row[0] + _HALF) * _WORD + row[1] + _HALF


def _search(keys: list[int]):
    """Column: the number of keys (sorted) at or below a row's (k1, k2)."""
    pairs = [_words(k) for k in keys]
    high, low = long_array([p[0] for p in pairs]), long_array([p[1] for p in pairs])
    return rank_in(len(keys), lambda i: (F.get(high, i) < F.col("k1")) | ((F.get(high, i) == F.col("k1")) & (F.get(low, i) <= F.col("k2"))))


def splitters(keyed: DataFrame, parts: int, per_part: int, tolerance: float = 0.001, probes: int = 16, rounds: int = 64) -> list[tuple[int, int]]:
    """Boundaries that cut keyed (k1, k2, size) into parts * per_part ranges: (key, rows below it), ascending.

    Every per_part-th boundary ends a shard and is within tolerance of a shard's bytes, or as near as
    keys allow (a key is never divided); those between only spread the work and are looser.
    """
    total = keyed.agg(F.sum("size"), F.count("*"), F.min(F.struct("k1", "k2")), F.max(F.struct("k1", "k2"))).first()
    cuts = parts * per_part
    if not total[1]:
        return [(0, 0)] * (cuts - 1)
    lo, hi = _key(total[2]), _key(total[3]) + 1
    share = total[0] / parts
    state = [
        _Open(total[0] * b / cuts, share * tolerance if b % per_part == 0 else share / per_part / 4, lo, hi, 0, 0, total[0], total[1])
        for b in range(1, cuts)
    ]
    for _ in range(rounds):
        open_ = [s for s in state if not s.done()]
        if not open_:
            break
        wanted: dict[tuple[int, int], int] = {}
        for s in open_:
            wanted[s.lo, s.hi] = wanted.get((s.lo, s.hi), 0) + 1
        keys = sorted({k for (a, b), n in wanted.items() for k in [a, b, *(a + (b - a) * i // (probes * n) for i in range(1, probes * n))]})
        cells = keyed.groupBy(_search(keys).alias("cell")).agg(F.sum("size"), F.count("*"), F.min(F.struct("k1", "k2")), F.max(F.struct("k1", "k2"))).collect()
        seen = {c[0]: c[1:] for c in cells}
        at = {k: i for i, k in enumerate(keys)}
        for s in open_:
            # cell i holds the keys from keys[i - 1] up to keys[i]
            below_bytes, below_rows = s.lo_bytes, s.lo_rows
            for i in range(at[s.lo] + 1, at[s.hi] + 1):
                if i not in seen:
                    continue
                size, rows, first, last = seen[i]
                if below_bytes + size >= s.target:
                    s.lo, s.lo_bytes, s.lo_rows = _key(first), below_bytes, below_rows
                    s.hi, s.hi_bytes, s.hi_rows = _key(last) + 1, below_bytes + size, below_rows + rows
                    break
                below_bytes, below_rows = below_bytes + size, below_rows + rows
    found, last = [], (0, 0)
    for s in state:
        last = max(last, s.best())
        found.append(last)
    return found


#: Splitters the driver holds at most: slices of 256 MB up to 16 TB of texts, then larger ones (1.5 GB at 100 TB), which are sorted on disk.
MOST_SLICES = 1 << 16


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.001, slice_bytes: int = 256 << 20, least_slices: int = 9) -> DataFrame:
    """docs with size, law, shard, slot and grown_shard; all columns of docs stay.

    Rows are ordered by (hash of the text, doc_id): equal texts are neighbours, so a group of copies
    lies in one shard or runs over into the next. Shards 0..shards-1 have near equal bytes (8 for a
    row, and the text's UTF-8 length; a null text counts 8); slot numbers a shard's rows from 0.
    Rows alike in text and doc_id share a key and a shard. A null doc_id sorts first. Empty input
    gives no rows. Extra columns named like the new ones are replaced.
    """
    docs = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard", "k1", "k2", "slice")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    keyed = docs.withColumns({"size": size, "k1": F.xxhash64(F.coalesce("text", F.lit(""))), "k2": F.coalesce(F.col("doc_id").cast("long"), F.lit(-_HALF))})
    probe = spool(keyed.select("k1", "k2", "size"), "shard-keys")
    total = probe.agg(F.sum("size")).first()[0] or 0
    per = max(least_slices, min(MOST_SLICES // shards, -(-total // (shards * slice_bytes))))
    cuts = splitters(probe, shards, per, tolerance)
    starts = [0, *(rows for _, rows in cuts)]
    base = [starts[s] - starts[s - s % per] for s in range(shards * per)]
    slice_ = _search([k for k, _ in cuts])
    order = Window.partitionBy("slice").orderBy("k1", "k2")
    return (
        keyed.withColumn("slice", slice_)
        .repartition("slice")
        .withColumns({
            "law": F.lit("bytes"),
            "shard": F.floor(F.col("slice") / per).cast("int"),
            "slot": F.get(long_array(base), F.col("slice")) + F.row_number().over(order) - 1,
            "grown_shard": F.lit(None).cast("int"),
        })
        .drop("k1", "k2", "slice")
    )


def op2_histogram_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("crc"))
    return shard(docs).select("doc_id", "size", F.col("crc").alias("text_crc32"), "law", "shard", "slot", "grown_shard")
