"""Best-fit-decreasing packing of token pieces into sequences of fixed length.

Piece lengths are at most the sequence length, so the multiset of lengths is a table of at most
`capacity` counts whatever the corpus holds. The driver runs best-fit decreasing on that table: a
segment tree over remaining capacities finds the tightest open bin for a length in logarithmic
time, and equal steps are taken together (a run of bins with one remaining capacity takes a run of
pieces of one length), which gives the same bins as piece by piece. The plan is a short list of
runs; each piece finds its place from its length and its rank among pieces of that length. Ranks
come from counts for each (task, length), so no length is gathered in one task.
"""

from __future__ import annotations

import zlib
from collections import deque

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane.llm.common import lean, spool
from pitlane.llm.tokens import coder, text_batches

CAPACITY = 4096
NEW = ("piece", "start", "length", "ids_crc32", "part", "rank", "ids", "sequence_id", "offset")
_PIECES = "piece int, start long, length long, ids_crc32 long, part int, rank long"


class CapacityTree:
    """Segment tree over remaining capacities 0..most: which have open bins, and the least one >= x."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, at: int, n: int) -> None:
        at += self.size
        while at:
            self.open[at] += n
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity >= least with an open bin: up while the right side is empty, then down."""
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, pieces to a sequence, first offset) of best-fit decreasing."""
    tree, bins, runs, fresh = CapacityTree(capacity), {}, [], 0

    def keep(rest: int, first: int, n: int) -> None:
        if rest and n:
            held = bins.setdefault(rest, deque())
            if held and held[-1][0] + held[-1][1] == first:
                held[-1] = (held[-1][0], held[-1][1] + n)
            else:
                held.append((first, n))
            tree.add(rest, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            rest = tree.tightest(length)
            if rest is None:
                rest, first, n = capacity, fresh, -(-left // (capacity // length))
                fresh += n
            else:
                first, n = bins[rest].popleft()
                tree.add(rest, -n)
            each = rest // length
            whole = min(n, left // each)
            some = min(left - whole * each, each) if whole < n else 0
            runs.append((length, rank, first, each, capacity - rest))
            keep(rest - each * length, first, whole)
            used = whole + bool(some)
            if some:
                keep(rest - some * length, first + whole, 1)
            if used < n:
                tree.add(rest, n - used)
                bins.setdefault(rest, deque()).appendleft((first + used, n - used))
            taken = whole * each + some
            rank, left = rank + taken, left - taken
    return runs


def _cut(path: str, end_id: int, capacity: int, keep: list[str], payload: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        model, part, ranks = coder(path, False), TaskContext.get().partitionId(), {}
        for batch in batches:
            for first, texts in text_batches(batch):
                ids, at = model.encode_column(texts)
                data = memoryview(np.insert(ids, at[1:], end_id).tobytes())
                at += np.arange(len(at))  # an end id more for each text before
                pieces = -(-np.diff(at) // capacity)
                row = np.repeat(np.arange(len(texts)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, at[row + 1] - at[row] - start)
                cuts = (4 * (at[row] + start)).tolist()
                held = [data[a : a + 4 * n] for a, n in zip(cuts, length.tolist())]
                rank = []
                for n in length.tolist():
                    ranks[n] = ranks.get(n, -1) + 1
                    rank.append(ranks[n])
                kept = batch.select(keep).take(pa.array(first + row))
                out = [pa.array(piece.astype("i4")), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in held], pa.int64()), pa.array(np.full(len(row), part, "i4")), pa.array(rank, pa.int64())]
                if payload:
                    out.append(pa.array([bytes(x) for x in held], pa.binary()))
                names = ["piece", "start", "length", "ids_crc32", "part", "rank", *["ids"] * payload]
                yield pa.RecordBatch.from_arrays([*kept.columns, *out], names=[*keep, *names])

    return run


def _place(runs: list[tuple[int, int, int, int, int]]):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        t = np.array(sorted(runs), "i8").reshape(-1, 5)
        key = (t[:, 0] << 48) + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype("i8") for c in ("length", "rank"))
            r = t[np.searchsorted(key, (length << 48) + rank, side="right") - 1]
            j = rank - r[:, 1]
            more = [pa.array(r[:, 2] + j // r[:, 3]), pa.array(r[:, 4] + j % r[:, 3] * length)]
            left = [c for c in batch.schema.names if c not in ("part", "rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in left), *more], names=[*left, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), end_id: int = 1, capacity: int = CAPACITY, payload: bool = False) -> DataFrame:
    """One row for each piece of docs' texts: the kept columns, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is its end id alone. Repeated rows are packed each for itself. No rows give
    no rows. Kept columns named like the new ones are replaced by them.
    """
    keep = [c for c in keep if c not in NEW]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), _PIECES, *["ids binary"] * payload])
    pieces = spool(docs.select(*keep, "text").mapInArrow(lean(_cut(tokenizer, end_id, capacity, keep, payload)), schema), "pieces")
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base").select(*pieces.columns)
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name not in ("part", "rank")), "sequence_id long, offset long"])
    return ranked.mapInArrow(_place(plan(counts, capacity)), out)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
