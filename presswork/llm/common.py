"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.session import scratch_path

#: A word of most operators: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A letter outside ASCII that a Unicode lower-casing might change.
OTHER_UPPER = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not use (case-insensitively)."""
    used = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in used:
            name = f"{stem}_{uuid.uuid4().hex[:6]}"
        used.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_words(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.

    The built-in ``lower`` is many times faster than ``translate`` and changes the same letters
    unless the text has other capitals, so only texts with such letters are translated.
    """
    return F.when(~text.rlike(OTHER_UPPER), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_path(path: str):
    """(file system, path in it) of a URI or a local path."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def by_partition(df: DataFrame, name: str) -> str:
    """Write ``df`` (with ``part``) so that a scan task finds the rows of its own partition."""
    path = scratch_path(df.sparkSession, name)
    df.repartition("part").write.partitionBy("part").parquet(path)
    return path


class Found:
    """What an earlier step found for the rows of a scan partition; see :func:`by_partition`."""

    def __init__(self, path: str):
        self.path, self.part, self.table = path, None, None

    def of(self, part: int) -> pa.Table | None:
        if self.part != part:
            fs, root = open_path(f"{self.path}/part={part}")
            there = fs.get_file_info(root).type.name == "Directory"
            self.table = pads.dataset(root, filesystem=fs, format="parquet").to_table() if there else None
            self.part = part
        return self.table
