"""Source trees as tables of files: walk, prune, route, read."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import languages
from ..functions import text
from ..session import ship
from . import globs

FILES = "path string, root string, rel_path string, language string, mtime_ms bigint, size bigint, content binary"
IGNORE_FILES = (".gitignore", ".ignore")


@dataclass(frozen=True)
class Options:
    """What a search looks at.  ``project_root``: relative roots are below it; results are kept there."""

    hidden: bool = False
    no_ignore: bool = False
    max_depth: int | None = None
    globs: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    project_root: str | None = None
    ignore_rules: tuple[tuple[str, str], ...] = field(default=())


def resolved(roots: list[str], project_root: str | None) -> list[str]:
    """The roots, relative ones below the project root; the project root itself without any."""
    base = (project_root or ".").rstrip("/")
    out = []
    for r in roots or ["."]:
        if r.startswith("/") or "://" in r:
            out.append(r)
        else:
            out.append(base if r in (".", "./") else f"{base}/{r.removeprefix('./')}")
    return out


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def missing(spark: SparkSession, roots: list[str]) -> list[str]:
    """Roots that don't exist, by the file system that Spark reads them from."""
    out = []
    for root in roots:
        path, fs = _path(spark, root)
        if not fs.exists(path):
            out.append(root)
    return out


def is_file(spark: SparkSession, root: str) -> bool:
    """Whether a root is a single file."""
    path, fs = _path(spark, root)
    return fs.exists(path) and fs.getFileStatus(path).isFile()


def _qualified(spark: SparkSession, root: str) -> tuple[str, bool]:
    path, fs = _path(spark, root)
    whole = fs.makeQualified(path).toString()
    return whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole, fs.getFileStatus(path).isFile()


def _skipped(spark: SparkSession, root: str) -> list[tuple[str, str, int, int]]:
    """(whole path, path below the root, mtime_ms, size) of the files that Spark's own listing passes over: those with
    a name, or in a folder with a name, that begins with a dot or an underscore.  Only these are kept of the walk."""
    base, single = _qualified(spark, root)
    odd = lambda rel: any(x[0] in "._" for x in rel.split("/") if x)
    found = []
    if base.startswith("/"):
        if single:
            name = base.rpartition("/")[2]
            stat = os.stat(base)
            return [(base, name, int(stat.st_mtime * 1000), stat.st_size)] if odd(name) else []
        for folder, _, names in os.walk(base):
            for name in names:
                rel = os.path.relpath(os.path.join(folder, name), base)
                if odd(rel) and os.path.isfile(os.path.join(folder, name)):
                    stat = os.stat(os.path.join(folder, name))
                    found.append((os.path.join(folder, name), rel, int(stat.st_mtime * 1000), stat.st_size))
        return found
    path, fs = _path(spark, root)
    files = fs.listFiles(path, True)
    while files.hasNext():
        status = files.next()
        whole = status.getPath().toString()
        rel = whole.rpartition("/")[2] if single else whole.removeprefix(base.rstrip("/") + "/")
        if odd(rel):
            found.append((whole, rel, status.getModificationTime(), status.getLen()))
    return found


def _content(path: str) -> bytes | None:
    fs, name = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with fs.open_input_file(name) as f:
        return f.read()


def _read(batches):
    """Contents of listed files, on the executors."""
    for batch in batches:
        content = [_content(p) for p in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(content, pa.binary())], names=[*batch.schema.names, "content"])


def _under(spark: SparkSession, root: str, options: Options, shown: str) -> DataFrame:
    base, single = _qualified(spark, root)
    skipped = _skipped(spark, root)
    wanted = languages.extensions_for(list(options.kinds) or None, list(options.languages) or None)
    rules = [] if options.no_ignore or single else [*ignore_rules(skipped), *options.ignore_rules]

    def kept(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("ext", text.extension(F.col("rel_path"))).filter(F.col("ext").isin(wanted))
        if single:  # a file that is named is taken whatever its name is
            return rows
        if not options.hidden:
            rows = rows.filter(~text.hidden(F.col("rel_path")))
        if options.max_depth is not None:
            rows = rows.filter(F.size(text.path_order(F.col("rel_path"))) <= options.max_depth)
        if options.globs:
            rows = rows.filter(globs.selected(F.col("rel_path"), list(options.globs)))
        return rows.filter(~globs.ignored(F.col("rel_path"), rules)) if rules else rows

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if len(wanted) == 1 and not single:
        reader = reader.option("pathGlobFilter", f"*.{wanted[0]}")  # before any file is opened
    whole = F.regexp_replace("path", "^file:/+", "/")
    rel = F.element_at(F.split(whole, "/"), -1) if single else text.relative(whole, base)
    rows = kept(reader.load(root).select(rel.alias("rel_path"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"), "content"))
    rows = rows.select("rel_path", "ext", "mtime_ms", "size", "content")
    odd = spark.createDataFrame(skipped, "whole string, rel_path string, mtime_ms bigint, size bigint")
    odd = kept(odd).mapInArrow(_read, "whole string, rel_path string, mtime_ms bigint, size bigint, ext string, content binary")
    rows = rows.unionByName(odd.drop("whole"))
    name = F.lit(shown) if single else F.concat(F.lit(shown.rstrip("/") + "/"), F.col("rel_path"))
    language = languages.routed(F.col("ext"), list(options.languages))
    return rows.select(name.alias("path"), F.lit(root).alias("root"), "rel_path", language.alias("language"), "mtime_ms", "size", "content")


def ignore_rules(skipped: list[tuple[str, str, int, int]]) -> list[tuple[str, str]]:
    """(folder, line) of all ignore files, outer folders first; they are few and small."""
    found = []
    for whole, rel, _, _ in skipped:
        folder, _, name = rel.rpartition("/")
        if name in IGNORE_FILES:
            found += [(folder, line) for line in (_content(whole) or b"").decode("utf-8", "replace").splitlines()]
    return sorted(found, key=lambda rule: rule[0].count("/") + bool(rule[0]))


def scan(spark: SparkSession, roots: list[str], options: Options) -> DataFrame:
    """Files below the roots that pass all options.  Overlapping roots give a file once for each.

    The pruning reads paths only; ``content`` is read of the files that are left.  ValueError names missing roots.
    """
    ship(spark)
    whole = resolved(roots, options.project_root)
    if gone := missing(spark, whole):
        raise ValueError(f"path does not exist: {', '.join(gone)}")
    shown = [r if options.project_root is None else w for r, w in zip(roots or ["."], whole)]
    return reduce(DataFrame.unionByName, [_under(spark, w, options, s) for w, s in zip(whole, shown)])
