"""Adapters: things with a name, health() and load(request) that give a Bundle."""

from __future__ import annotations

import importlib
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from pathlib import Path
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession

from pitlane.errors import ConfigurationError, SecurityBoundaryError
from pitlane.sources.bundle import Bundle
from pitlane.sources.contracts import KINDS, Request

PASS, WARN, FAIL = "PASS", "WARN", "FAIL"
ENTRY_POINTS = "pitlane.adapters"


@dataclass(frozen=True)
class Health:
    status: str
    messages: tuple[str, ...] = ()


@runtime_checkable
class Adapter(Protocol):
    name: str

    def health(self) -> Health: ...

    def load(self, request: Request) -> Bundle: ...


def resolve_within(root: Path | str, path: str, allow_outside: bool = False) -> Path:
    """path below root; URIs and ways out are refused unless allowed."""
    if "://" in str(path):
        raise SecurityBoundaryError(f"a local path is needed, not {path!r}")
    root = Path(root).expanduser().resolve()
    full = (root / Path(path).expanduser()).resolve()
    if not allow_outside and not full.is_relative_to(root):
        raise SecurityBoundaryError(f"{path!r} leaves {root}")
    return full


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file (all columns as text; quotes are doubled, cells may hold line ends) or a Parquet one."""
    suffix = Path(path).suffix.lower()
    if suffix == ".csv":
        return spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("inferSchema", False).csv(path)
    if suffix in (".parquet", ".pq"):
        return spark.read.parquet(path)
    raise ConfigurationError(f"unsupported file type: {suffix or path!r}")


@dataclass(frozen=True)
class FileAdapter:
    """A file for each table; prices are required. Own metadata wins over what the adapter says of itself.

    Symbols and bounds are applied before the contracts run, so Parquet scans read only what was asked for;
    what lies outside a request is not validated.
    """

    spark: SparkSession
    prices: str
    features: str | None = None
    events: str | None = None
    universe: str | None = None
    metadata: dict = field(default_factory=dict)
    root: str = "."
    allow_outside_root: bool = False
    name: str = "files"

    def __post_init__(self):
        if not self.prices:
            raise ConfigurationError("a prices file is required")
        object.__setattr__(self, "paths", {k: str(resolve_within(self.root, p, self.allow_outside_root)) for k in KINDS if (p := getattr(self, k))})

    def health(self) -> Health:
        gone = [f"{k}: {p} is missing" for k, p in self.paths.items() if not Path(p).exists()]
        return Health(FAIL, tuple(gone)) if gone else Health(PASS) if len(self.paths) == len(KINDS) else Health(WARN, tuple(f"no {k}" for k in KINDS if k not in self.paths))

    def load(self, request: Request | None = None) -> Bundle:
        request = request or Request()
        wanted = {k: scan(self.spark, p) for k, p in self.paths.items() if k in request.kinds}
        bundle = Bundle.of(self.spark, {"adapter": self.name, "data_classification": "user_supplied", **self.metadata}, **wanted)
        return bundle.select(request)


def adapter_class(name: str):
    """`module:object`, or the name of an installed entry point."""
    module, _, attribute = name.partition(":")
    if attribute:
        try:
            return getattr(importlib.import_module(module), attribute)
        except (ImportError, AttributeError) as e:
            raise ConfigurationError(f"no adapter {name!r}: {e}") from e
    if name == FileAdapter.name:
        return FileAdapter
    found = {e.name: e for e in entry_points(group=ENTRY_POINTS)}
    if name not in found:
        raise ConfigurationError(f"unknown adapter {name!r}; known: {', '.join(sorted({FileAdapter.name, *found}))}")
    return found[name].load()


class SqliteReader:
    """Tables of a SQLite file that every executor can open, split by ranges of rowid."""

    def __init__(self, path: str, parts: int = 8):
        self.path, self.parts = path, parts

    def __call__(self, spark: SparkSession, table: str) -> DataFrame:
        import sqlite3
        from contextlib import closing

        if not table.isidentifier():
            raise ConfigurationError(f"no table name: {table!r}")
        with closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as c:
            columns = [r[1] for r in c.execute(f"pragma table_info({table})")]
            low, high = c.execute(f"select min(rowid), max(rowid) from {table}").fetchone()
        if not columns:
            raise ConfigurationError(f"no table {table!r} in {self.path}")
        path, step = self.path, max(1, -(-((high or 0) - (low or 0) + 1) // self.parts))

        def rows(batches):
            import pyarrow as pa

            schema = pa.schema([(c, pa.string()) for c in columns])
            with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as c:
                for batch in batches:
                    for start in batch.column("id").to_pylist():
                        found = c.execute(f"select * from {table} where rowid >= ? and rowid < ?", (start, start + step))
                        while chunk := found.fetchmany(10_000):
                            yield pa.RecordBatch.from_arrays([pa.array([None if v is None else str(v) for v in x], pa.string()) for x in zip(*chunk)], schema=schema)

        starts = spark.range(low or 0, (high or 0) + 1, step, self.parts)
        return starts.mapInArrow(rows, ", ".join(f"`{c}` string" for c in columns))


@dataclass(frozen=True)
class SqliteAdapter:
    """The four tables of a SQLite database; prices are required."""

    spark: SparkSession
    path: str
    metadata: dict = field(default_factory=dict)
    name: str = "sqlite"

    def _tables(self) -> set[str]:
        import sqlite3
        from contextlib import closing

        with closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as c:
            return {r[0] for r in c.execute("select name from sqlite_master where type = 'table'")} & set(KINDS)

    def health(self) -> Health:
        if not Path(self.path).exists():
            return Health(FAIL, (f"{self.path} is missing",))
        return Health(PASS) if "prices" in self._tables() else Health(FAIL, ("no table prices",))

    def load(self, request: Request | None = None) -> Bundle:
        request, read = request or Request(), SqliteReader(self.path)
        tables = {k: read(self.spark, k) for k in KINDS if k in request.kinds and k in self._tables()}
        return Bundle.of(self.spark, {"adapter": self.name, "data_classification": "user_supplied", **self.metadata}, **tables).select(request)
