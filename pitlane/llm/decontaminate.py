"""Benchmark passages in training text, found with spaced seeds.

A seed is the hash of the tokens that a fixed mask selects in a window; positions the mask leaves
out may differ. Seeds of the benchmark and of all documents are joined, and around each hit the
document and the item are compared token by token on the hit's diagonal, so a passage with a few
words replaced is still found. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlane.llm.common import spool

#: Fixed masks of four tokens, so chosen that every alignment that leaks() asks for holds one of them whole (a test counts all).
MASKS = ("1111", "10111", "11011", "110101", "111001", "1000111", "1101001")
WINDOW, WINDOW_MATCH, ITEM_SHARE, ITEM_LEAST, ITEM_TOKENS = 13, 0.75, 0.6, 8, 6
BROADCAST_BYTES = 16 << 20


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, mask and seed of every window of rows (keys, h)."""
    span = max(map(len, MASKS))
    shifted = F.arrays_zip(*(F.slice("h", k + 1, F.greatest(F.size("h"), F.lit(1))).alias(f"t{k}") for k in range(span)))
    at = rows.select(*keys, F.posexplode(shifted).alias("pos", "t")).select(*keys, "pos", *(F.col(f"t.t{k}").alias(f"t{k}") for k in range(span)))
    seeds = []
    for m, mask in enumerate(MASKS):
        used = [F.col(f"t{k}") for k, on in enumerate(mask) if on == "1"]
        seeds.append(F.when(F.col(f"t{len(mask) - 1}").isNotNull(), F.xxhash64(F.lit(m), *used)))
    return at.select(*keys, "pos", F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item of which it holds a passage.

    doc_id, text_hash, item_id, start (first token of the item's place in the document; below 0 where
    the passage begins inside the item), matched (equal tokens there) and item_tokens.

    A leak is an alignment without gaps in which some WINDOW tokens of the item (all, if it is
    shorter) have WINDOW_MATCH of them equal, or ITEM_SHARE of the whole item, ITEM_LEAST at least,
    is equal. Each has a seed. Items under ITEM_TOKENS tokens match nothing; so do null and empty texts.
    Repeated rows give one result. Rows with a null id take part like others. Other columns are ignored.
    """
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), token_hashes(F.col("text")).alias("h"))
    items = spool(benchmark.select("item_id", token_hashes(F.col("text")).alias("h")).where(F.size("h") >= ITEM_TOKENS).distinct(), "items")
    seeds = spool(_seeds(items, ["item_id", "h"]).select("item_id", F.col("h").alias("g"), F.col("pos").alias("at"), "seed"), "seeds")
    keyed = seeds.select("seed", "item_id", F.xxhash64("g").alias("item_hash"), "at")
    if seeds.count() * 48 <= BROADCAST_BYTES:
        keyed = F.broadcast(keyed)
    hits = _seeds(docs, ["doc_id", "text_hash"]).join(keyed, "seed").select("doc_id", "text_hash", "item_id", "item_hash", (F.col("pos") - F.col("at")).alias("start")).distinct()
    hits = spool(hits, "hits")
    few = hits.count() * 80 <= BROADCAST_BYTES
    wanted = hits.groupBy(F.col("doc_id").alias("doc"), F.col("text_hash").alias("thash")).agg(F.collect_list(F.struct("item_id", "item_hash", "start")).alias("found"))
    if few:
        wanted = F.broadcast(wanted)
    joined = docs.join(wanted, docs.doc_id.eqNullSafe(F.col("doc")) & (docs.text_hash == F.col("thash")))
    one = joined.select("doc_id", "text_hash", "h", F.explode("found").alias("f")).select("doc_id", "text_hash", "h", "f.item_id", "f.item_hash", "f.start")
    # items' tokens join last and once for each item, so what is broadcast are the items themselves, measured by their tokens
    names = items.select(F.col("item_id").alias("item"), F.xxhash64("h").alias("hash"), F.col("h").alias("g"))
    if (items.agg(F.sum(F.size("h") * 8 + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        names = F.broadcast(names)
    one = one.join(names, one.item_id.eqNullSafe(F.col("item")) & (one.item_hash == F.col("hash"))).select("doc_id", "text_hash", "h", "item_id", "start", "g")
    equal = F.transform("g", lambda t, i: (F.get("h", F.col("start") + i) == t).cast("int"))
    equal = F.transform(equal, lambda x: F.coalesce(x, F.lit(0)))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + x)
    size = F.size("g")
    wide = F.least(size, F.lit(WINDOW))
    best = F.array_max(F.transform(F.sequence(F.lit(1), size - wide + 1), lambda s: total(F.slice("equal", s, wide))))
    judged = one.withColumn("equal", equal).withColumns({"best": best, "matched": total(F.col("equal")), "item_tokens": size})
    found = judged.where((F.col("best") >= F.ceil(wide * WINDOW_MATCH)) | ((F.col("matched") >= ITEM_SHARE * F.col("item_tokens")) & (F.col("matched") >= ITEM_LEAST)))
    first = F.max(F.struct("matched", (-F.col("start")).alias("start"), "item_tokens"))
    return found.groupBy("doc_id", "text_hash", "item_id").agg(first.alias("m")).select("doc_id", "text_hash", "item_id", (-F.col("m.start")).alias("start"), "m.matched", "m.item_tokens")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no passage of benchmark.

    Null and empty texts hold none; repeated rows stay or go together; rows with a null id take part; an
    empty benchmark drops nothing; no rows give no rows. All columns of docs are kept as they are.
    """
    gone = spool(leaks(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "leaks")
    if gone.count() * 48 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    return docs.join(gone, docs.doc_id.eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash")), "left_anti")


def op6_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, benchmark).select("doc_id", "item_id", "start", "matched", "item_tokens")
