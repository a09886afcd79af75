"""Append-only trial ledger: JSON lines chained by hash, with a checkpoint of the last one beside them."""

from __future__ import annotations

import hashlib
import json
import math
import os
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

GENESIS = "genesis"
FIELDS = ("index", "timestamp", "kind", "run_id", "strategy_name", "strategy_fingerprint", "config_fingerprint", "data_fingerprint", "label", "prev_hash")
RUNS = ("backtest", "demo")


def canonical_json(value) -> str:
    """Sorted keys, no spaces, ASCII; values that aren't finite become null."""

    def plain(x):
        if isinstance(x, float) and not math.isfinite(x):
            return None
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def entry_hash(entry: dict) -> str:
    return hashlib.sha256(canonical_json({k: entry[k] for k in FIELDS}).encode()).hexdigest()


@dataclass(frozen=True)
class Ledger:
    path: Path

    @property
    def head(self) -> Path:
        return self.path.with_name(self.path.name + ".head")

    def entries(self) -> list[dict]:
        """The lines that parse, in order."""
        out = []
        if self.path.exists():
            for line in self.path.read_text().splitlines():
                try:
                    x = json.loads(line)
                except ValueError:
                    continue
                if isinstance(x, dict):
                    out.append(x)
        return out

    def append(self, kind: str, label: str = "", **fields: str) -> dict:
        """Add an entry; kind is backtest, demo or note, fields are the run's fingerprints and names. One writer at a time."""
        before = self.entries()
        entry = dict.fromkeys(FIELDS) | {"index": len(before), "timestamp": datetime.now(UTC).isoformat(timespec="seconds"), "kind": kind, "label": label[:200], "prev_hash": before[-1]["entry_hash"] if before else GENESIS}
        unknown = set(fields) - set(FIELDS)
        if unknown:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        entry |= fields
        entry["entry_hash"] = entry_hash(entry)
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a") as out:
            out.write(canonical_json(entry) + "\n")
            out.flush()
            os.fsync(out.fileno())
        self.head.write_text(canonical_json({"count": len(before) + 1, "last_hash": entry["entry_hash"]}))
        return entry

    def verify(self) -> tuple[bool, str]:
        good, why, _ = self.check()
        return good, why

    def check(self) -> tuple[bool, str, int | None]:
        """(holds, why, first bad line): whether every line parses, chains to the one before it and hashes to itself, and the checkpoint, where there is one, agrees. Blank lines don't count."""
        if not self.path.exists():
            there = self.head.exists()
            return (not there, "the ledger is gone but its checkpoint is there" if there else "no ledger", None)
        last, lines = GENESIS, [x for x in self.path.read_text().splitlines() if x.strip()]
        for i, line in enumerate(lines):
            try:
                x = json.loads(line)
                good = x["index"] == i and x["prev_hash"] == last and x["entry_hash"] == entry_hash(x)
            except (ValueError, KeyError, TypeError):
                good = False
            if not good:
                return False, f"entry {i} doesn't hold", i
            last = x["entry_hash"]
        if self.head.exists():
            try:
                head = json.loads(self.head.read_text())
            except ValueError:
                return False, "the checkpoint can't be read", None
            if head != {"count": len(lines), "last_hash": last}:
                return False, "the checkpoint disagrees with the chain", None
        return True, "the chain holds", None

    def summary(self) -> dict:
        """Runs, distinct strategy variants among them (one at least) and the first name of each."""
        runs = [x for x in self.entries() if x.get("kind") in RUNS]
        names: dict[str, str] = {}
        for x in runs:
            if x.get("strategy_fingerprint"):
                names.setdefault(x["strategy_fingerprint"], x.get("strategy_name") or "")
        return {"runs": len(runs), "variants": max(1, len(names)), "names": dict(sorted(names.items()))}


def chained(spark, path: str):
    """position, index, kind, chained of a ledger's parsable lines as a table: does each name the hash of the one before it.

    Lines are numbered in file order; a ledger is one small file with one writer, so one task orders it.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\n")).alias("line", "text")).where(F.trim("text") != "")
    fields = spark.createDataFrame([], ", ".join(f"`{f}` {'int' if f == 'index' else 'string'}" for f in (*FIELDS, "entry_hash"))).schema
    rows = lines.select("line", F.from_json("text", fields).alias("x")).where("x.entry_hash is not null").select("line", "x.*")
    order = Window.orderBy("line")
    before = F.lag("entry_hash", 1, GENESIS).over(order)
    return rows.select((F.row_number().over(order) - 1).alias("position"), "index", "kind", ((F.col("prev_hash") == before) & (F.col("index") == F.row_number().over(order) - 1)).alias("chained"))
