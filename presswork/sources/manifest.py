"""What a store consists of: a log of commits, each written last.

A writer first puts its rows into a folder of its own and then appends one small Parquet file to ``_manifest``. Readers
take the folders that the log names and that no later commit replaces. So an append and an enrichment may overlap,
neither loses the other's rows, and what a killed writer left behind is never read.

Kinds of entries: ``data`` (article rows), ``delta`` (changed enrichment), ``index`` (keys by bucket) and ``run`` (a rule
set was applied to all rows of a window up to a commit). ``seq`` numbers the data commits: an index or a run names the
last one it has seen. ``version`` numbers the enrichments. One ingest at a time writes data.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from presswork.session import path_exists

MANIFEST = "_manifest"
COLUMNS = {"kind": "string", "folder": "string", "first_id": "bigint", "next_id": "bigint", "n": "bigint",
           "dates": "array<struct<pub_date: date, n: bigint>>", "seq": "bigint", "version": "bigint", "rules": "string", "start": "timestamp_ntz",
           "buckets": "int", "replaces": "array<string>"}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())
#: Folder of rows that were in a plain partitioned folder before it had a manifest.
PLAIN = "."


@dataclass
class State:
    """The commits that a reader sees, and those that were replaced."""

    entries: list[Row] = field(default_factory=list)
    listed: bool = True  # whether there is a manifest

    def __post_init__(self) -> None:
        gone = {f for e in self.entries for f in e.replaces or ()}
        self.live = [e for e in self.entries if e.folder is None or e.folder not in gone]

    def of(self, kind: str) -> list[Row]:
        return [e for e in self.live if e.kind == kind]

    @property
    def next_id(self) -> int:
        return max((e.next_id for e in self.entries if e.kind == "data"), default=0)

    @property
    def seq(self) -> int:
        return max((e.seq for e in self.entries if e.kind == "data"), default=0)

    @property
    def version(self) -> int:
        return max((e.version or 0 for e in self.entries), default=0)

    @property
    def indexed(self) -> int:
        """The last data commit whose keys are in the index."""
        return max((e.seq for e in self.of("index")), default=0)

    def evaluated(self, rules: str, start: dt.datetime) -> int:
        """The last data commit whose rows from ``start`` on carry the results of a rule set: no other was applied since."""
        seen = 0
        for run in sorted(self.of("run"), key=lambda e: -e.version):
            if run.rules != rules:
                break
            if run.start <= start:
                seen = max(seen, run.seq)
        return seen


def state(spark: SparkSession, path: str) -> State:
    """The store's commits: one row each, collected."""
    root = path.rstrip("/")
    if path_exists(spark, f"{root}/{MANIFEST}"):
        return State(spark.read.schema(SCHEMA).parquet(f"{root}/{MANIFEST}").collect())
    if path_exists(spark, f"{root}/pub_date=*"):  # rows of other code, or a version folder
        rows = spark.read.option("basePath", root).parquet(f"{root}/pub_date=*")
        return State([entry("data", PLAIN, seq=1, **extent(rows))], listed=False)
    return State([], listed=False)


def entry(kind: str, folder: str | None = None, **values) -> Row:
    return Row(*COLUMNS)(*[{"kind": kind, "folder": folder, **values}.get(c) for c in COLUMNS])


def new_folder(kind: str) -> str:
    return f"{kind}/commit={uuid.uuid4().hex}"


def extent(rows) -> dict:
    """Number, dates and range of ids of written rows: one row for each date."""
    by_date = rows.groupBy("pub_date").agg(F.count(F.lit(1)).alias("n"), F.min("arrival_id").alias("a"), F.max("arrival_id").alias("z")).collect()
    ids = [r.a for r in by_date if r.a is not None], [r.z for r in by_date if r.z is not None]
    return {"n": sum(r.n for r in by_date), "dates": [(r.pub_date, r.n) for r in by_date],
            "first_id": min(ids[0], default=0), "next_id": max(ids[1], default=-1) + 1}


def publish(spark: SparkSession, path: str, *entries: Row) -> None:
    """Make a commit visible: one file with all of its entries."""
    spark.createDataFrame(list(entries), SCHEMA).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/{MANIFEST}")
