"""Removal of long repeated passages: bounded interval expansion on a Burrows-Wheeler transform.

Every string of `length` bytes that starts in two places is found, over all documents at once, and
each byte such a string covers is removed.

1. Cutting. The least hash of the ANCHOR-byte strings inside a string of `length` bytes depends on
   that string alone, so equal strings meet under one hash. Starts that share its place are a chunk.
   Chunks whose hash occurs once cannot repeat and end here, without their bytes being moved.
2. Chunks of equal content become one, with its number of copies. A hash with a single content is
   settled by that number.
3. The rest are dealt into buckets of about a megabyte by their hash. A bucket's chunks, each with an
   end mark of its own, are sorted by suffix (no deeper than needed), and the transform is extended
   backward breadth first: intervals of strings of 1, 2, 3 ... bytes in turn set the common prefix of
   neighbouring suffixes to that value. The expansion stops at `length`; what is unset then shares at
   least `length` bytes with its neighbour. A start is repeated if it does, or if its chunk has copies.
4. A hash whose distinct contents alone exceed HOT_BYTES is never gathered: its starts are counted
   by a 128-bit hash of their strings instead, an exact way for such groups in bounded memory.
5. Runs of repeated starts return to every copy's document, which drops the covered bytes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane.llm.common import discard, lean, spool

LENGTH, ANCHOR = 400, 64
BUCKET_BYTES, HOT_BYTES = 1 << 20, 2 << 20
NEW = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "kept_text")
_powers: list = []


def _rolling(data, width: int, which: int = 0):
    """64-bit hashes of all strings of `width` bytes in an array of bytes."""
    import numpy as np

    if not _powers or len(_powers[0][0]) <= len(data):
        n = max(1 << 16, 2 * len(data))
        _powers.clear()
        for seed in (11, 12):
            r = np.random.default_rng(seed)
            a = int(r.integers(1, 1 << 62)) * 2 + 1
            up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]), dtype=np.uint64) for x in (a, pow(a, -1, 1 << 64)))
            _powers.append((up, down, r.integers(0, 1 << 63, 256, dtype=np.uint64)))
    up, down, table = _powers[which]
    h = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * up[: len(data)], dtype=np.uint64)])
    g = (h[width:] - h[: len(h) - width]) * down[: len(data) - width + 1]
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(32)
    return g


def chunks_of(text: bytes, length: int = LENGTH):
    """(anchor hash, first start, starts) of a text's chunks."""
    import numpy as np

    if len(text) < length:
        return ()
    g = _rolling(np.frombuffer(text, np.uint8), ANCHOR)
    w, n = length - ANCHOR + 1, len(text) - length + 1
    pad = -len(g) % w
    b = np.concatenate([g, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    before = np.minimum.accumulate(b, axis=1).ravel()
    after = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n], before[w - 1 : w - 1 + n])
    # a new chunk begins where the least hash changes or its leftmost place is left behind, so one chunk never holds a string twice
    cut = np.flatnonzero((least[1:] != least[:-1]) | (g[: n - 1] == least[:-1])) + 1
    first = np.concatenate([[0], cut])
    size = np.diff(np.concatenate([first, [n]]))
    return least[first].view(np.int64), first, size


def _cut(length: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            rows, hashes, contents, firsts, sizes = [], [], [], [], []
            for i, t in enumerate(batch.column("text")):
                text = (t.as_py() or "").encode()
                found = chunks_of(text, length)
                if found:
                    rows.append(np.full(len(found[0]), i))
                    hashes.append(found[0])
                    firsts.append(found[1])
                    sizes.append(found[2])
                    contents += [xxhash.xxh3_64_intdigest(text[f : f + s + length - 1]) for f, s in zip(found[1].tolist(), found[2].tolist())]
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hashes)), pa.array(np.array(contents, np.uint64).view(np.int64)), batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(np.concatenate(firsts).astype("i4")), pa.array(np.concatenate(sizes).astype("i4"))],
                    names=["anchor", "content", "doc_id", "text_hash", "first", "starts"],
                )

    return run


def _bytes_of(length: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for text, found in zip(batch.column("text"), batch.column("found")):
                text, found = text.as_py().encode(), found.as_py()
                data = [text[x["first"] : x["first"] + x["starts"] + length - 1] for x in found]
                cols = [pa.array([x[c] for x in found], t) for c, t in (("anchor", pa.int64()), ("content", pa.int64()), ("copies", pa.int64()), ("hot", pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(data, pa.binary())], names=["anchor", "content", "copies", "hot", "data"])

    return run


def suffix_order(symbols, marks: int, depth: int):
    """Suffixes ordered by their first `depth` symbols at least; the least `marks` symbols occur once each and end a text.

    Seven symbols go into the first key (beyond an end mark, the mark alone decides), and prefixes then
    double; only suffixes that still share a place with another are sorted again.
    """
    import numpy as np

    n = len(symbols)
    key, mark, over = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(7):
        s = np.zeros(n, np.int64)
        s[: n - k] = symbols[k:]
        ends = (s < marks) & ~over
        mark[ends] = s[ends] + 1
        over |= ends
        key = (key << 9) + np.where(over, 0, s - marks + 1)
    order = np.lexsort((mark, key))
    new = np.concatenate([[True], (key[order[1:]] != key[order[:-1]]) | (mark[order[1:]] != mark[order[:-1]])])
    slots, rank, k = np.arange(n), np.empty(n, np.int64), 7
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    shared = ~(new & np.concatenate([new[1:], [True]]))
    slots = slots[shared]
    while k < depth and len(slots):
        at = order[slots]
        pair = rank[at] * (n + 1) + np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[slots] = at
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.concatenate([new[1:], [True]]))]
        k *= 2
    return order


def unset_prefixes(texts: list[bytes], length: int):
    """(positions in suffix order, which neighbours share at least `length` bytes, starts of the texts).

    share[i] says that suffixes order[i - 1] and order[i] agree in their first `length` bytes.
    """
    import numpy as np

    marks = len(texts)
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes) - 1
    s = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + marks
    s[ends] = np.arange(marks)
    n = len(s)
    order = suffix_order(s, marks, length)
    bwt = s[order - 1]  # the symbol before each suffix; before the first text stands the last mark
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n)
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    counts = np.bincount(s)
    right = np.cumsum(counts[counts > 0])
    left = right - counts[counts > 0]
    unset[right] = False
    for _ in range(1, length):
        if not len(left):
            break
        one = right - left == 1
        single = left[one]
        single = single[bwt[single] >= marks]
        new_left = lf[single]
        new_right = new_left + 1
        many_l, many_r = left[~one], right[~one]
        if len(many_l):
            size = many_r - many_l
            which = np.repeat(np.arange(len(size)), size)
            pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(many_l, size)
            c = bwt[pos]
            inside = c >= marks
            key = which[inside] * 256 + (c[inside] - marks)
            pos = pos[inside]
            by = np.argsort(key, kind="stable")
            key, pos = key[by], pos[by]
            if len(key):
                edge = np.flatnonzero(key[1:] != key[:-1])
                begin, end = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(key) - 1]])
                new_left = np.concatenate([new_left, lf[pos[begin]]])
                new_right = np.concatenate([new_right, lf[pos[end]] + 1])
        fresh = unset[new_right]
        left, right = new_left[fresh], new_right[fresh]
        unset[right] = False
    return order, unset, ends - sizes + 1


def repeated_starts(texts: list[bytes], copies: list[int], length: int = LENGTH):
    """A flag for each start (0 .. len - length) of each text: does its string start in another place too."""
    import numpy as np

    order, share, first = unset_prefixes(texts, length)
    flags = np.zeros(len(order), bool)
    flags[order] = share[:-1] | share[1:]
    return [np.ones(len(t) - length + 1, bool) if n > 1 else flags[f : f + len(t) - length + 1] for t, n, f in zip(texts, copies, first.tolist())]


def _runs(flags) -> list[int]:
    """Begin and end (exclusive) of the runs of set flags, one after the other."""
    import numpy as np

    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).tolist()


def _bucket(length: int):
    def run(table):
        import pyarrow as pa

        runs = [_runs(f) for f in repeated_starts([d.as_py() for d in table.column("data")], table.column("copies").to_pylist(), length)]
        out = pa.table({"anchor": table.column("anchor"), "content": table.column("content"), "runs": pa.array(runs, pa.list_(pa.int32()))})
        return out.filter(pa.array([bool(r) for r in runs]))

    return run


def _grams(length: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i, d in enumerate(batch.column("data")):
                data = np.frombuffer(d.as_py(), np.uint8)
                a, b = (_rolling(data, length, k).view(np.int64) for k in (0, 1))
                same = [pa.array(np.full(len(a), batch.column(c)[i].as_py(), "i8")) for c in ("anchor", "content", "copies")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(a), pa.array(b), pa.array(np.arange(len(a), dtype="i4"))], names=["anchor", "content", "copies", "h1", "h2", "start"])

    return run


def _whole_characters(data: bytes, drop) -> str:
    """The text of the characters of which no byte is dropped."""
    import numpy as np

    raw = np.frombuffer(data, np.uint8)
    if not drop.any():
        return data.decode()
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    size = np.diff(np.append(first, len(raw)))
    return raw[~np.repeat(np.add.reduceat(drop, first, dtype=np.int64) > 0, size)].tobytes().decode()


def _keep(length: int, keep: list[str], payload: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for t, found in zip(batch.column("text"), batch.column("__found")):
                data = (t.as_py() or "").encode()
                gone = np.zeros(len(data) + 1, np.int32)
                for x in found.as_py() or ():
                    runs = np.array(x["runs"]) + x["first"]
                    np.add.at(gone, runs[::2], 1)
                    np.add.at(gone, runs[1::2] + length - 1, -1)
                drop = np.cumsum(gone)[:-1] > 0
                rest = np.frombuffer(data, np.uint8)[~drop].tobytes()
                for c, v in zip(out, (len(data), int(drop.sum()), len(_runs(drop)) // 2, hashlib.sha256(rest).hexdigest(), len(rest), _whole_characters(data, drop) if payload else None)):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "kept_text"]
            n = 6 if payload else 5
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, t) for c, t in list(zip(out, types))[:n])], names=[*keep, *names[:n]])

    return run


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text_hash and found (first, runs of repeated starts counted from it) of each text that holds one."""
    spark = docs.sparkSession
    cut = spool(docs.mapInArrow(lean(_cut(length)), "anchor long, content long, doc_id long, text_hash long, first int, starts int"), "chunks", tidy=True)
    each = cut.groupBy("anchor", "content", "starts").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_hash", "first")).alias("at"))
    each = spool(each, "contents", "lz4", True)
    met = each.groupBy("anchor").agg(F.sum("copies").alias("total"), F.sum((F.col("starts") + length - 1).cast("long")).alias("bytes"), F.count("*").alias("contents")).where("total > 1")
    met = spool(each.join(met, "anchor").select("anchor", "content", "starts", "copies", "at", (F.col("contents") == 1).alias("alone"), (F.col("bytes") > HOT_BYTES).alias("hot")), "repeated", "lz4", True)
    discard(each)
    done = [met]
    # copies of one content alone: every string of it is repeated, and it meets nothing else
    copied = met.where("alone").select("anchor", "content", F.array(F.lit(0), F.col("starts")).alias("runs"))
    met = met.where(~F.col("alone"))
    total = met.agg(F.sum((F.col("starts") + length - 1).cast("long"))).first()[0] or 0
    wanted = met.select(F.col("at.doc_id").alias("__id"), F.col("at.text_hash").alias("__hash"), F.struct("anchor", "content", F.col("at.first").alias("first"), "starts", "copies", "hot").alias("x"))
    wanted = wanted.groupBy("__id", "__hash").agg(F.collect_list("x").alias("found"))
    source = docs.join(wanted, docs.doc_id.eqNullSafe(F.col("__id")) & (docs.text_hash == F.col("__hash"))).select("text", "found")
    done.append(spool(source.mapInArrow(lean(_bytes_of(length)), "anchor long, content long, copies long, hot boolean, data binary"), "bytes", tidy=True))
    data = done[-1].dropDuplicates(["anchor", "content"])
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    dealt = data.where(~F.col("hot")).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    runs = dealt.groupBy("bucket").applyInArrow(_bucket(length), "anchor long, content long, runs array<int>")
    if met.where("hot").limit(1).count():
        grams = spool(data.where("hot").mapInArrow(lean(_grams(length)), "anchor long, content long, copies long, h1 long, h2 long, start int"), "grams", "lz4", True)
        done.append(grams)
        often = grams.groupBy("h1", "h2").agg(F.sum("copies").alias("n")).where("n > 1").select("h1", "h2")
        by_chunk = grams.join(often, ["h1", "h2"]).groupBy("anchor", "content").agg(F.collect_set("start").alias("starts"))
        runs = runs.unionByName(by_chunk.select("anchor", "content", F.flatten(F.transform("starts", lambda s: F.array(s, s + 1))).alias("runs")))
    runs = spool(runs.unionByName(copied), "runs", "lz4", True)
    discard(*done)
    back = cut.select("anchor", "content", "doc_id", "text_hash", "first").distinct().join(runs, ["anchor", "content"])
    found = spool(back.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "runs")).alias("found")), "found", "lz4", True)
    discard(cut, runs)
    return found


def drop_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH, payload: bool = False) -> DataFrame:
    """The kept columns of docs, n_bytes, n_removed, n_spans, kept_sha256 and n_kept (and kept_text, of characters kept whole) of each row.

    A null text is empty. Texts under `length` bytes lose nothing. A row that appears twice loses
    every string of `length` bytes in both. Rows of null doc_id take part. No rows give no rows. Kept
    columns named like the new ones are replaced by them; others are ignored.
    """
    keep = tuple(c for c in keep if c not in NEW)
    named = docs.select(*dict.fromkeys([*keep, "doc_id", "text"])).withColumn("__text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = repeated_runs(named.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__text_hash").alias("text_hash"), "text"), length)
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("found").alias("__found"))
    joined = named.join(found, named.doc_id.eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left")
    joined = joined.select(*dict.fromkeys([*keep, "text"]), "__found")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long", *["kept_text string"] * payload])
    return joined.mapInArrow(lean(_keep(length, list(keep), payload)), schema)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the passages repeated over `length` bytes or more taken out of text (a character cut in two goes whole) and n_chars brought up to date.

    Null and empty texts stay as they are; of repeated rows none keeps the passage; rows with a null id take
    part; no rows give no rows. Other columns are kept as they are, whatever their names.
    """
    own = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    bare = docs.withColumnsRenamed(own)
    rest = drop_repeats(bare, tuple(bare.columns), length, payload=True)
    out = rest.withColumn("text", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))).select(*bare.columns).withColumnsRenamed({v: k for k, v in own.items()})
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op3_interval_expansion(spark, sf_dir: str) -> DataFrame:
    """The digests of what stays of every document, and the text itself."""
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), payload=True)
