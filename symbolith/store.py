"""Kept results: definitions by file, reused while time and size of a file are the same."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import relational
from .operators.extract import extract

FOLDER, VERSION = ".symbolith", 1
ROWS = "path string, mtime_ms bigint, size bigint, language string, defs array<struct<ordinal: int, kind: string, line_start: int, line_end: int, scope: string, signature: string>>"


def location(project_root: str) -> str:
    return f"{project_root.rstrip('/')}/{FOLDER}/v{VERSION}"


def _current(spark: SparkSession, project_root: str) -> str | None:
    """The newest complete table; each write is a folder of its own that a marker file completes."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(location(project_root))
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return None
    done = sorted((s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(base) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return done[-1][1] if done else None


def load(spark: SparkSession, project_root: str | None) -> DataFrame | None:
    """What is kept, None if there is nothing or it can't be read."""
    path = project_root and _current(spark, project_root)
    if not path:
        return None
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    return rows if set(rows.columns) == {"path", "mtime_ms", "size", "language", "defs"} else None


def save(rows: DataFrame, project_root: str) -> None:
    """Writes beside the old table, then removes the old one: readers see the one or the other."""
    spark = rows.sparkSession
    old, new = _current(spark, project_root), f"{location(project_root)}/{uuid.uuid4().hex}"
    rows.write.parquet(new)
    if old:
        path = spark._jvm.org.apache.hadoop.fs.Path(old)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def refreshed(files: DataFrame, kept: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Definitions and errors of the files, and the rows to keep for files that had to be read.

    Files whose time and size are kept come from the kept rows, the others are extracted.
    """
    if kept is None:
        missed, hits = files, None
    else:
        status = relational.looked_up(files, kept).persist()
        missed = status.filter("status <> 'hit'").drop("status")
        hits = kept.join(status.filter("status = 'hit'").select("path").distinct(), "path", "left_semi")
    defs, errors = extract(missed)
    each = defs.groupBy("path").agg(F.collect_list(F.struct("ordinal", "kind", "line_start", "line_end", "scope", "signature")).alias("defs"))
    # a file without definitions is kept too, one that couldn't be read is not
    read = missed.select("path", "mtime_ms", "size", "language").distinct().join(errors.select("path").distinct(), "path", "left_anti")
    updates = read.join(each, "path", "left").select("path", "mtime_ms", "size", "language", F.coalesce("defs", F.array().cast("array<struct<ordinal: int, kind: string, line_start: int, line_end: int, scope: string, signature: string>>")).alias("defs"))
    if hits is not None:
        defs = unnested(hits).unionByName(defs)
    return defs, errors, updates


def unnested(kept: DataFrame) -> DataFrame:
    return kept.select("path", "language", F.explode("defs").alias("d")).select("path", "d.ordinal", "language", *[f"d.{c}" for c in ("kind", "line_start", "line_end", "scope", "signature")])


def vacuum(spark: SparkSession, project_root: str, files: DataFrame) -> None:
    """Drops what is kept of files that are gone."""
    if (kept := load(spark, project_root)) is not None:
        save(relational.vacuumed(kept, files), project_root)


