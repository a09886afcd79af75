"""Quality rules judged for hosts.

Each document is tested against a few rules over its whole text: the base rules, symbols, repeated
lines. Failures are counted for each host (the source), each host's rate is shrunk with a beta prior
fitted to the spread of all hosts' rates, and the verdict on a host joins back to its documents: a
host whose lower posterior bound lies above the prior's own upper bound (mean and z deviations), so
one worse than hosts of this corpus are, or above one half, loses all its documents. Beyond the base rules nothing
else drops a document.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlane.llm.common import spool

BROADCAST_ROWS, SALTS = 100_000, 16
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def text_counts(text: str) -> tuple[int, int, int, int, int, int]:
    """COUNTS of one text. Words are runs without ASCII white space."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _BLANKS))
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    repeats = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen, covered, last = Counter(windows), 0, -1
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    covered += i + 2 - max(i - 1, last)
                    last = i + 2
            repeats = covered
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines)


@lru_cache(1)
def _counts():
    """The function from a column of texts to COUNTS; only texts go to Python and only numbers come back."""

    @F.arrow_udf(", ".join(f"{c} long" for c in COUNTS))
    def counts(texts: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow

        table = np.array([text_counts(t.as_py() or "") for t in texts], "i8").reshape(-1, len(COUNTS))
        return pyarrow.StructArray.from_arrays([pyarrow.array(table[:, i]) for i in range(len(COUNTS))], names=list(COUNTS))

    return counts


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns of docs and COUNTS of each text (null: none)."""
    return docs.select(*keep, _counts()("text").alias("__counts")).select(*keep, "__counts.*")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def own_failed() -> Column:
    """Mostly symbols (over a tenth of the characters in words), or over half the lines repeated; counts against the host only."""
    return (10 * F.col("n_symbols") > F.col("word_chars")) | (2 * F.col("n_dup_lines") > F.col("n_lines"))


def host_verdicts(counted: DataFrame, z: float = 1.645, most: float = 0.5) -> DataFrame:
    """host, host_docs, host_failed, host_rate (posterior mean), host_bound (lower), host_limit and host_rejected. Five sums reach the driver.

    The prior's mean is the corpus rate; its strength (2 to 1000 documents) follows from how far hosts'
    rates lie apart beyond chance. The limit, z deviations above the mean and `most` at most, is the same for all hosts.
    """
    host = counted.groupBy(F.coalesce("source", F.lit("")).alias("host")).agg(F.count("*").alias("host_docs"), F.sum((base_failed() | own_failed()).cast("long")).alias("host_failed"))
    n, rate = F.col("host_docs"), F.col("host_failed") / F.col("host_docs")
    s = host.agg(F.sum("host_failed").alias("bad"), F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(n.cast("double") * n).alias("n2"), F.sum(n * rate * rate).alias("r2")).first()
    total = s["n"] or 0
    mean = (s["bad"] + 0.5) / (total + 1) if total else 0.5
    strength = 1000.0
    if total and s["k"] > 1:
        free, spread = total - s["n2"] / total, s["r2"] - total * (s["bad"] / total) ** 2
        between = (spread - (s["k"] - 1) * mean * (1 - mean)) / free if free > 0 else 0.0
        strength = min(1000.0, max(2.0, mean * (1 - mean) / between - 1)) if between > 0 else 1000.0
    a, b = F.lit(mean * strength) + F.col("host_failed"), F.lit((1 - mean) * strength) + n - F.col("host_failed")
    bound = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    limit = F.lit(min(most, mean + z * (mean * (1 - mean) / (strength + 1)) ** 0.5))
    return host.withColumns({"host_rate": a / (a + b), "host_bound": bound, "host_limit": limit, "host_rejected": bound > limit})


def judge(counted: DataFrame, verdicts: DataFrame) -> DataFrame:
    """counted with base_failed, host_rate, host_rejected and kept. A host table of over BROADCAST_ROWS rows is joined by shuffling, where large hosts are dealt out in SALTS parts."""
    v = verdicts.select("host", "host_rate", "host_rejected")
    named = counted.withColumn("host", F.coalesce("source", F.lit("")))
    if v.count() <= BROADCAST_ROWS:
        joined = named.join(F.broadcast(v), "host")
    else:
        salted = v.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = named.withColumn("__salt", F.pmod(F.xxhash64(*COUNTS, F.col("doc_id") if "doc_id" in counted.columns else F.lit(0)), F.lit(SALTS)).cast("int")).join(salted, ["host", "__salt"]).drop("__salt")
    return joined.drop("host").withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | F.col("host_rejected")))


def host_rules(docs: DataFrame) -> DataFrame:
    """doc_id, source, COUNTS, base_failed, host_rate, host_rejected and kept of each row of docs.

    A null text has no words and fails. Rows without a source are one host. Repeated rows count and
    are judged each for itself. No rows give no rows. Other columns are ignored.
    """
    counted = spool(with_counts(docs, ["doc_id", "source"]), "quality")
    return judge(counted, host_verdicts(counted))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that host_rules keeps, with docs' own columns; columns named like a count are set aside meanwhile.

    Null and empty texts fail the base rules and go; rows without a source are one host; repeated rows
    stay or go together; no rows give no rows. Texts are counted once: rows and counts are written, then judged.
    """
    own = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in ("text", "source")}
    bare = docs.withColumnsRenamed(own)
    counted = spool(with_counts(bare, bare.columns), "counted")
    kept = judge(counted, host_verdicts(counted)).where("kept")
    return kept.select(*bare.columns).withColumnsRenamed({v: k for k, v in own.items()})


def op9_host_rules(spark, sf_dir: str) -> DataFrame:
    rows = host_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", F.round("host_rate", 6).alias("host_rate"), "host_rejected")
