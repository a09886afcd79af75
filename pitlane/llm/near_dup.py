"""Near-duplicate documents by an inverted join on MinHash signature coordinates.

1. Texts with equal shingle sets are one class; only classes are compared.
2. A class is posted under (coordinate, value) pairs of its signature. Two sets that agree in at
   least `match` of `k` coordinates agree in one of the first k - match + 1, whatever the order of
   coordinates, if that order is the same for all. Frequent pairs come last in it and are mostly
   skipped. (Which pairs are frequent is estimated; the order changes the work, never the result.)
3. Posting lists are merged: each member meets the list's leader. A candidate's collisions are
   counted over all coordinates, posted or skipped, and pairs above the threshold, `match`, are
   confirmed on their full sets. Confirmed links
   give components; pairs inside one are skipped from here on.
4. Lists that still span several components are finished. In a short one, the remaining pairs across
   components are tried in the same way. Longer ones are gathered around the component that holds
   most of the list; its other members are compared, block against block, with the component's
   members and among themselves: first signatures, then the full sets of rows with a likely partner. A block pair sends no more links than it has rows, so no
   link that joins two components is lost and the pairs of a large group are never listed.

At similarity 0.75 a pair agrees in 72 +- 4.2 of 96 coordinates; match=50 misses one in ten million.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane.llm.common import lean, spool

K, MATCH, PERCENT = 96, 50, 75
#: Tables up to this many bytes are broadcast; larger ones are joined by shuffling both sides.
BROADCAST_BYTES = 16 << 20
_HOT_MOST = 1 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, marked for broadcast if its counted rows stay under BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _sketch(batches):
    import pyarrow as pa

    from pitlane.llm.shingles import Signer, column_sets, digest

    sign = Signer(K)
    for batch in batches:
        names, sizes, signatures = [], [], []
        for s in column_sets(batch.column("text")):
            sizes.append(len(s))
            names.append(digest(s) if len(s) else None)
            signatures.append(sign(s).view("i4") if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.list_(pa.int32()))],
            names=["doc_id", "text_hash", "digest", "n_shingles", "signature"],
        )


def _post(hot):
    """Rows (pair, node): the first K - MATCH + 1 pairs of each class, those in hot (sorted) last."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at = np.arange(K, dtype="i8") << 32
        for batch in batches:
            values = batch.column("signature").flatten().to_numpy(zero_copy_only=False).view("u4").reshape(-1, K)
            pairs = at + values.astype("i8")
            if len(hot):
                late = hot[np.minimum(np.searchsorted(hot, pairs), len(hot) - 1)] == pairs
                pairs = np.take_along_axis(pairs, np.argsort(late, axis=1, kind="stable"), axis=1)
            n = K - MATCH + 1
            nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), n)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, :n].ravel()), pa.array(nodes)], names=["pair", "node"])

    return run


def _confirm(batches):
    import pyarrow as pa

    from pitlane.llm.shingles import alike, digest, shingle_set

    last: tuple = (None, None)
    for batch in batches:
        a, b, keep = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
        da, db = batch.column("digest_a"), batch.column("digest_b")
        ta, tb = batch.column("text_a"), batch.column("text_b")
        for i in range(len(a)):
            if last[0] != (a[i], text := ta[i].as_py()):
                s = shingle_set(text)
                last = ((a[i], text), s if digest(s) == da[i].as_py() else None)
            other = shingle_set(tb[i].as_py())
            if last[1] is not None and digest(other) == db[i].as_py() and alike(last[1], other, PERCENT):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) among pairs (a, b): MATCH equal coordinates, then the sets of the whole texts."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("signature").alias(f"s{x}"), F.col("doc_id").alias(f"doc_{x}"), F.col("digest").alias(f"digest_{x}"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    likely = spool(pairs.join(side("a"), "a").join(side("b"), "b").where(agree >= MATCH).drop("sa", "sb"), "pairs")
    wanted = small(likely.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct(), 32)
    texts = spool(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), "texts")
    text = lambda x: texts.select(F.col("doc_id").alias(f"doc_{x}"), F.col("text").alias(f"text_{x}"))
    both = likely.join(text("b"), "doc_b").join(text("a"), "doc_a").select("a", "b", "digest_a", "digest_b", "text_a", "text_b")
    return spool(both.mapInArrow(lean(_confirm), "a long, b long").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node reachable over links (a, b). Least labels spread along links and labels of labels are followed, until nothing changes."""
    both = spool(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = spool(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = spool(step.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label")), "labels")
        changed = labels.where("old <> label").limit(1).count()
        labels = labels.select("node", "label")
        if not changed:
            return labels


def _sets(batches):
    import pyarrow as pa

    from pitlane.llm.shingles import column_sets, digest

    for batch in batches:
        rows, out = [], []
        for i, s in enumerate(column_sets(batch.column("text"))):
            if digest(s) == batch.column("digest")[i].as_py():
                rows.append(i)
                out.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(rows, pa.int64())), pa.array(out, pa.binary())], names=["node", "shingles"])


def _links_between(left: list, right: list, labels_left, labels_right) -> list[tuple[int, int]]:
    """Row pairs of alike sets under different labels, as few as join the same rows: exact intersections by matrix products."""
    import numpy as np

    n, sizes = len(left), np.array([len(x) for x in [*left, *right]])
    flat, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    in_left, in_right = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    in_left[at[row < n]] = True
    in_right[at[row >= n]] = True
    column = np.cumsum(in_left & in_right) - 1
    use = (in_left & in_right)[at]
    row, at, wide = row[use], column[at[use]], int(column[-1]) + 1
    both = np.zeros((n, len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for c in range(0, wide, 2048):
        part = slice(*np.searchsorted(at, (c, c + 2048)))
        m = np.zeros((len(sizes), 2048), np.float32)
        m[row[part], at[part] - c] = 1
        both += m[:n] @ m[n:].T
    both = both.astype("i8")
    alike = (100 * both >= PERCENT * (sizes[:n, None] + sizes[None, n:] - both)) & (np.asarray(labels_left)[:, None] != np.asarray(labels_right)[None, :])
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(alike)):
        a, b = root(labels_left[i]), root(labels_right[j])
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def _cell(table):
    import numpy as np
    import pyarrow as pa

    node, label, side = (table.column(c).to_pylist() for c in ("node", "label", "side"))
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
    pick = lambda k: [i for i, x in enumerate(side) if x in k]
    left, right = pick((0, 2)), pick((1, 2))
    found = _links_between([sets[i] for i in left], [sets[i] for i in right], [label[i] for i in left], [label[i] for i in right]) if left and right else []
    return pa.table({"a": pa.array([node[left[i]] for i, _ in found], pa.int64()), "b": pa.array([node[right[j]] for _, j in found], pa.int64())})


def _likely(table):
    """The rows of a cell that agree in MATCH coordinates with a row of the other side under another label."""
    import numpy as np
    import pyarrow as pa

    signature = np.array(table.column("signature").combine_chunks().flatten()).reshape(-1, K)
    label, side = (np.array(table.column(c)) for c in ("label", "side"))
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    equal = np.zeros((len(left), len(right)), np.uint8)
    for k in range(K):
        equal += signature[left, k][:, None] == signature[right, k][None, :]
    met = (equal >= MATCH) & (label[left][:, None] != label[right][None, :])
    keep = np.zeros(len(side), bool)
    keep[left[met.any(axis=1)]] = True
    keep[right[met.any(axis=0)]] = True
    return table.drop_columns(["signature"]).filter(pa.array(keep))


def _long_lists(held: DataFrame, classes: DataFrame, docs: DataFrame, block: int = 1024) -> DataFrame:
    """Links (a, b) across labels within the lists held (pair, node, label), compared block against block on full sets."""
    most = held.groupBy("pair", "label").count().groupBy("pair").agg(F.max_by("label", F.struct("count", "label")).alias("anchor"))
    near = spool(held.join(most, "pair").select("anchor", "node", "label").distinct(), "around", "lz4")
    own = F.col("label") == F.col("anchor")
    sizes = near.groupBy("anchor").agg(F.sum(own.cast("long")).alias("own"), F.sum((~own).cast("long")).alias("other"))
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    near = near.join(sizes.where("other > 0").select("anchor", blocks("own").alias("m"), blocks("other").alias("s")), "anchor")
    at = F.pmod(F.xxhash64("node"), F.when(own, F.col("m")).otherwise(F.col("s"))).cast("int")
    # cells (x, y): other block x with member block y; (x, -1 - y): other block x with other block y >= x
    each_s, each_m = F.sequence(F.lit(0), F.col("s") - 1), F.sequence(F.lit(0), F.col("m") - 1)
    cell = lambda x, y, side: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(side).cast("int").alias("side"))
    others = F.concat(
        F.when(F.col("m") > 0, F.transform(each_m, lambda y: cell(F.col("at"), y, 0))).otherwise(F.array().cast("array<struct<x:int,y:int,side:int>>")),
        F.transform(
            each_s,
            lambda y: F.when(y == F.col("at"), cell(y, -1 - y, 2)).when(y > F.col("at"), cell(F.col("at"), -1 - y, 0)).otherwise(cell(y, -1 - F.col("at"), 1)),
        ),
    )
    cells = near.withColumn("at", at).select("anchor", "node", "label", F.explode(F.when(own, F.transform(each_s, lambda x: cell(x, F.col("at"), 1))).otherwise(others)).alias("c"))
    cells = cells.select("anchor", "node", "label", "c.x", "c.y", "c.side").join(classes.select("node", "signature"), "node")
    cells = spool(cells.groupBy("anchor", "x", "y").applyInArrow(_likely, "node long, anchor long, label long, x int, y int, side int"), "cells", "lz4")
    wanted = classes.join(small(cells.select("node").distinct(), 24), "node", "left_semi").select("node", "doc_id", "digest")
    wanted = small(spool(wanted, "wanted", "lz4"), 64)
    sets = spool(docs.join(wanted, "doc_id").select("node", "digest", "text").mapInArrow(lean(_sets), "node long, shingles binary").dropDuplicates(["node"]), "sets", "lz4")
    return spool(cells.join(sets, "node").groupBy("anchor", "x", "y").applyInArrow(_cell, "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, short: int = 16) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept of each row of docs.

    Documents without words, and rows whose doc_id is null, are linked with nothing and kept. Rows of
    one doc_id and shingle set are judged alike. No rows give no rows. Other columns are ignored.
    Lists of up to `short` members are finished pair by pair, longer ones by blocks.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = spool(
        docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))).mapInArrow(lean(_sketch), "doc_id long, text_hash long, digest binary, n_shingles long, signature array<int>"), "sketch", "lz4"
    )
    usable = sketch.where("digest is not null and doc_id is not null")
    classes = spool(usable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")).withColumn("node", F.monotonically_increasing_id()), "classes", "lz4")
    n = classes.count()
    key = lambda c: (F.shiftleft(F.col("pos").cast("long"), 32) + F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))).alias("pair")
    sample = classes.where(F.pmod(F.xxhash64("digest"), F.lit(8)) == 0).select(F.posexplode("signature").alias("pos", "value")).select(key("value"))
    often = sample.groupBy("pair").count().where(F.col("count") >= max(4, -(-K * n // _HOT_MOST)))
    import numpy as np

    hot = np.sort(np.array([r[0] for r in often.orderBy(F.desc("count"), "pair").limit(_HOT_MOST).select("pair").collect()], "i8"))
    posted = classes.select("node", "signature").mapInArrow(lean(_post(hot)), "pair long, node long")
    lists = posted.groupBy("pair").agg(F.min("node").alias("leader"), F.count("*").alias("size")).where("size > 1")
    lists = spool(posted.join(lists, "pair"), "postings", "lz4")
    pairs = spool(lists.where("leader < node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "met", "lz4")
    links = _verified(pairs, classes, docs)
    labels = components(links)
    held = lists.select("pair", "node", "size").join(labels, "node", "left").select("pair", "node", "size", F.coalesce("label", "node").alias("label"))
    spans = held.groupBy("pair").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("pair")
    held = spool(held.join(spans, "pair", "left_semi"), "spanning", "lz4")
    few, many = held.where(F.col("size") <= short), held.where(F.col("size") > short).select("pair", "node", "label")
    x, y = few.select("pair", F.col("node").alias("a"), F.col("label").alias("la")), few.select("pair", F.col("node").alias("b"), F.col("label").alias("lb"))
    met = x.join(y, "pair").where("a < b and la <> lb").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    links = links.union(_verified(spool(met, "met", "lz4"), classes, docs))
    if many.limit(1).count():
        links = links.union(_long_lists(many, classes, docs))
    labels = components(links)
    named = classes.select("node", "digest", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_set = spool(named.join(least, "label").select("digest", "component_id"), "components", "lz4")
    out = sketch.select("doc_id", "text_hash", "digest", "n_shingles").join(by_set, "digest", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document is its component's first.

    Null and empty texts, and rows with a null id, stay. Rows of one doc_id and equal text stay or go
    together. No rows give no rows. All columns of docs are kept as they are.
    """
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id", "text_hash").distinct()
    gone = small(spool(gone, "gone"), 48).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    return docs.join(gone, (F.col("doc_id") == F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash")), "left_anti")


def op5_signature_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
