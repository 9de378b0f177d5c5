"""Operators over the table of definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import text
from ..pattern import Pattern, any_matches


def by_kind(defs: DataFrame, tags: list[str]) -> DataFrame:
    """Definitions of the kinds that the tags stand for; all without tags."""
    return defs.filter(F.col("kind").isin(model.resolve(tags))) if tags else defs


def by_pattern(defs: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Definitions whose scope, container names included, matches any of the patterns."""
    return defs.filter(any_matches(patterns, F.col("scope")))


def by_depth(defs: DataFrame, most: int) -> DataFrame:
    return defs.filter(text.scope_depth(F.col("scope")) <= most)


def without_accessors(defs: DataFrame) -> DataFrame:
    """Without getters and setters that share file, first line and scope with a property or subscript still there."""
    place = Window.partitionBy("path", "line_start", "scope")
    anchored = F.max(F.col("kind").isin("property", "subscript")).over(place)
    return defs.withColumn("_anchored", anchored).filter(~(F.col("kind").isin("getter", "setter") & F.col("_anchored"))).drop("_anchored")


def in_order(defs: DataFrame) -> DataFrame:
    """By path, component by component, then as the definitions were found."""
    return defs.orderBy(text.path_order(F.col("path")), "ordinal")


def outline(defs: DataFrame) -> DataFrame:
    """``contained``: the definition ends no later than an earlier one of its file."""
    before = Window.partitionBy("path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return defs.withColumn("contained", F.col("line_end") <= F.coalesce(F.max("line_end").over(before), F.lit(0)))


def counts(defs: DataFrame) -> DataFrame:
    return defs.groupBy("path").agg(F.count("*").alias("n"))


def files(defs: DataFrame) -> DataFrame:
    return defs.select("path").distinct()


def summary(defs: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row: definitions, files with definitions, errors."""
    found = defs.groupBy("path").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matched"), F.count("*").alias("files"))
    if errors is None:
        return found.withColumn("errors", F.lit(0).cast("long"))
    return found.crossJoin(errors.agg(F.count("*").alias("errors")))  # one row each


def head(defs: DataFrame, limit: int, mode: str = "files") -> DataFrame:
    """The first definitions in path order.  ``files``: whole files while their definitions, added up, are at most the
    limit; ``rows``: that many definitions.

    A file's share is found without one global window: files are counted first, and the running sum is over these
    counts alone, cut to the first ``limit`` files, as each has a definition.
    """
    if mode == "rows":
        return in_order(defs).limit(limit)
    first = counts(defs).orderBy(text.path_order(F.col("path"))).limit(limit)
    running = Window.orderBy(text.path_order(F.col("path"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = first.withColumn("sum", F.sum("n").over(running)).filter(F.col("sum") <= limit).select("path")
    return defs.join(kept, "path", "left_semi")


def stored(defs: DataFrame) -> DataFrame:
    """With signatures as they are stored."""
    return defs.withColumn("signature", text.cut_bytes(F.col("signature"), text.STORED))


def search(defs: DataFrame, patterns: list[Pattern], tags: list[str] = (), depth: int | None = None) -> DataFrame:
    """Filters by kind, pattern and depth, then drops accessors that stand beside their property."""
    found = by_pattern(by_kind(defs, list(tags)), patterns)
    return without_accessors(found if depth is None else by_depth(found, depth))


# ---- stored results ----


def looked_up(files: DataFrame, stored_files: DataFrame) -> DataFrame:
    """``files`` with status hit (same time and size), stale or missing, by path."""
    old = stored_files.select("path", F.col("mtime_ms").alias("old_mtime_ms"), F.col("size").alias("old_size"))
    same = (F.col("mtime_ms") == F.col("old_mtime_ms")) & (F.col("size") == F.col("old_size"))
    status = F.when(F.col("old_size").isNull(), "missing").when(same, "hit").otherwise("stale")
    return files.join(old, "path", "left").withColumn("status", status).drop("old_mtime_ms", "old_size")


def merged(stored_rows: DataFrame, updates: DataFrame, touched: DataFrame) -> DataFrame:
    """Stored rows of files that weren't parsed anew, and the rows of those that were (``touched``, by path)."""
    return stored_rows.join(touched.select("path").distinct(), "path", "left_anti").unionByName(updates)


def vacuumed(stored_rows: DataFrame, files: DataFrame) -> DataFrame:
    """Stored rows of files that are still there."""
    return stored_rows.join(files.select("path").distinct(), "path", "left_semi")


# ---- output ----


def lines(defs: DataFrame, signature: bool = True, filename: bool = True) -> DataFrame:
    """``line``: path, range, kind and scope, signature."""
    parts: list[Column] = [F.col("path"), F.lit(":")] if filename else []
    parts += [text.line_range(F.col("line_start"), F.col("line_end")), F.lit(" ["), F.col("kind"), F.lit("/"), F.col("scope"), F.lit("]")]
    if signature:
        parts.append(F.when(F.col("signature") != "", F.concat(F.lit(" "), text.shown(F.col("signature")))).otherwise(F.lit("")))
    return defs.select("path", "ordinal", F.concat(*parts).alias("line"))


def ndjson(defs: DataFrame, errors: DataFrame | None = None, matches: bool = True) -> DataFrame:
    """``json``: for each file a begin, its matches and an end, then a summary; rank and ordinal give the order."""
    data = F.struct("path", "line_start", "line_end", "kind", "scope", "signature")
    body = defs.select("path", F.lit(1).alias("rank"), "ordinal", F.to_json(F.struct(F.lit("match").alias("type"), data.alias("data"))).alias("json"))
    n = counts(defs)
    event = lambda kind, rank, *cols: n.select("path", F.lit(rank).alias("rank"), F.lit(0).alias("ordinal"), F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*cols).alias("data"))).alias("json"))
    total = summary(defs, errors).select(F.lit(None).cast("string").alias("path"), F.lit(3).alias("rank"), F.lit(0).alias("ordinal"), F.to_json(F.struct(F.lit("summary").alias("type"), F.struct("matched", "files", "errors").alias("data"))).alias("json"))
    out = event("begin", 0, "path").unionByName(event("end", 2, "path", F.col("n").alias("matched"))).unionByName(total)
    return out.unionByName(body) if matches else out


def ndjson_in_order(events: DataFrame) -> DataFrame:
    return events.orderBy(F.col("path").isNull(), text.path_order(F.col("path")), "rank", "ordinal").select("json")
