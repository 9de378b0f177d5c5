"""Search and outline over source trees or tables of definitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import languages, model, store
from .operators import relational as ops
from .pattern import Case, Pattern
from .sources.scan import Options, scan


@dataclass
class Result:
    """Definitions that were found, and errors (path, phase, message)."""

    defs: DataFrame
    errors: DataFrame

    def status(self) -> int:
        """2 with any error, 1 without a definition, 0 otherwise."""
        if self.errors.head(1):
            return 2
        return 0 if self.defs.head(1) else 1


def definitions(spark: SparkSession, roots: list[str], options: Options, keep: bool = False) -> Result:
    """All definitions below the roots; with ``keep``, results below the project root are reused and renewed."""
    files = scan(spark, roots, options)
    kept = store.load(spark, options.project_root) if keep else None
    defs, errors, updates = store.refreshed(files, kept)
    if keep and options.project_root:
        updates = updates.persist()
        if updates.head(1):
            merged = updates if kept is None else ops.merged(kept, updates, updates)
            store.save(merged, options.project_root)
            kept = store.load(spark, options.project_root)
            paths = files.select("path").distinct()
            defs = store.unnested(kept.join(paths, "path", "left_semi"))
    return Result(defs, errors)


def search(
    spark: SparkSession,
    patterns: list[str],
    roots: list[str] = (),
    *,
    kinds: list[str] = (),
    case: Case = Case.SENSITIVE,
    word: bool = False,
    max_scope_depth: int | None = None,
    options: Options = Options(),
    keep: bool = False,
) -> Result:
    """Definitions whose scope matches any pattern, of the kinds and depth, accessors beside their property dropped.

    ValueError for unknown kinds or languages, missing roots, and patterns that are invalid or match no name.
    """
    parsed = [Pattern.parse(p, case, word) for p in patterns]
    wanted = model.resolve(list(kinds))
    languages.validated(list(options.languages))
    within = Options(**{**options.__dict__, "kinds": tuple(wanted) if kinds else ()})
    found = definitions(spark, list(roots), within, keep)
    return Result(ops.search(found.defs, parsed, list(kinds), max_scope_depth), found.errors)


def outline(spark: SparkSession, roots: list[str] = (), **options) -> Result:
    """All definitions in file order; ``contained`` marks those inside an earlier one."""
    found = search(spark, [r"\w*"], roots, **options)
    return Result(ops.outline(found.defs), found.errors)


def text_lines(result: Result, *, signature: bool = True, filename: bool = True, heading: bool = False, survey: bool = False) -> list[str]:
    """The output as lines of text, in path order."""
    rows = ops.lines(result.defs, signature, filename and not heading)
    if survey:
        inner = F.concat_ws(" ", ops.text.line_range(F.col("line_start"), F.col("line_end")), *([ops.text.shown(F.col("signature"))] if signature else []))
        rows = rows.join(result.defs.select("path", "ordinal", "contained", inner.alias("inner")), ["path", "ordinal"])
        if not signature:
            rows = rows.filter("not contained")
        rows = rows.withColumn("line", F.when(F.col("contained"), F.col("inner")).otherwise(F.col("line")))
    out, last = [], None
    for r in ops.in_order(rows).select("path", "line").toLocalIterator():
        if heading and r["path"] != last:
            out += ([""] if last is not None else []) + [r["path"]]
            last = r["path"]
        out.append(r["line"])
    return out
