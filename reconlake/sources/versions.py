"""Several tables that change together: a version is written aside and becomes current by one rename.

A folder holds the tables of each version below names of their own, and a
manifest for each committed version. A reader follows the last manifest, so it
sees all tables as they were before a write or all as they are after it; what a
killed write left behind is named by no manifest. Of two writers that began
from the same version one is refused. Parts of a table are written in the order
given, so that composites lie there before their atoms.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest-"


class Conflict(RuntimeError):
    """Another writer has committed since."""


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    path, fs = _files(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[len(MANIFEST) :]) for n in names if n.startswith(MANIFEST))


def current(spark: SparkSession, folder: str) -> int:
    """Number of the last committed version; 0 if there is none."""
    return max(_manifests(spark, folder), default=0)


def _tables(spark: SparkSession, folder: str, version: int) -> dict[str, str]:
    rows = spark.read.text(f"{folder}/{MANIFEST}{version:012d}", wholetext=True).collect()  # a line of a few names
    return json.loads(rows[0][0])


def read(spark: SparkSession, folder: str, table: str, version: int | None = None) -> DataFrame:
    """A table as of a version, by default the current one."""
    number = current(spark, folder) if version is None else version
    if not number:
        raise FileNotFoundError(f"{folder} has no committed version")
    return spark.read.parquet(f"{folder}/{_tables(spark, folder, number)[table]}")


def commit(spark: SparkSession, folder: str, tables: Mapping[str, Sequence[DataFrame]], based_on: int | None = None) -> int:
    """Writes the parts of each table, then makes them the next version; tables that aren't given stay. based_on: the version that the rows were made from, by default the current one.

    Frames may read the version that they replace. Nothing is visible before the
    manifest has its name, which is one rename that fails if the name is taken.
    """
    before = current(spark, folder)
    based_on = before if based_on is None else based_on
    if based_on != before:
        raise Conflict(f"version {before} was committed after {based_on}")
    names = _tables(spark, folder, before) if before else {}
    for table, parts in tables.items():
        names[table] = f"{table}-{uuid.uuid4().hex}"
        for part in parts:
            part.write.mode("append").option("compression", "zstd").parquet(f"{folder}/{names[table]}")
    path, fs = _files(spark, folder)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    aside = jvm.org.apache.hadoop.fs.Path(path, f"_{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(json.dumps(names), "utf-8"))
    out.close()
    named = jvm.org.apache.hadoop.fs.Path(path, f"{MANIFEST}{before + 1:012d}")
    strict = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf).rename(fs.makeQualified(aside), fs.makeQualified(named), strict)
    except Exception as e:
        if fs.exists(named):
            raise Conflict(f"version {before + 1} was committed meanwhile") from e
        raise
    return before + 1


def prune(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Deletes all but the last `keep` versions, and what belongs to no version; not while a write is under way."""
    path, fs = _files(spark, folder)
    kept = _manifests(spark, folder)[-keep:]
    used = {f"{MANIFEST}{n:012d}" for n in kept} | {name for n in kept for name in _tables(spark, folder, n).values()}
    for status in fs.listStatus(path):
        if status.getPath().getName() not in used:
            fs.delete(status.getPath(), True)
