"""Registered queries of the engine's operators, with the SQL that DuckDB checks them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import languages, model
from ..functions import text
from ..operators import relational as ops
from ..pattern import Case, Pattern
from ..sources import globs
from . import derived, extraction

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ALL_COLUMNS = "path, ordinal, kind, line_start, line_end, scope, signature"


def _on_defs(name: str, sql: str, plan: Callable[[DataFrame], DataFrame]) -> None:
    """A query over the derived definitions; ``sql`` follows its common table expressions."""
    QUERIES[name] = lambda spark, sf_dir: plan(derived.defs(spark, sf_dir))
    SQL[name] = f"WITH {derived.SQL} {sql}"


def _in(kinds: list[str]) -> str:
    return ", ".join(f"'{k}'" for k in kinds)


for _name, _tag in {"kind_filter": "macro", "category_filter": "callable", "declaration_pair": "function", "definition_suffix": "function_definition"}.items():
    _on_defs(_name, f"SELECT {ALL_COLUMNS} FROM defs WHERE kind IN ({_in(model.kinds_of(_tag))})", lambda d, t=_tag: ops.by_kind(d, [t]))
for _name, _patterns, _case, _word, _where in [
    ("pattern_substring", ["art1"], Case.SENSITIVE, False, "contains(scope, 'art1')"),
    ("pattern_regex", [r"^Part[0-4]+\b.*small$"], Case.SENSITIVE, False, r"regexp_matches(scope, '^Part[0-4]+\b.*small$')"),
    ("pattern_or", ["Top7", "promo"], Case.SENSITIVE, False, "contains(scope, 'Top7') OR contains(scope, 'promo')"),
    ("pattern_ignorecase", ["PART4"], Case.INSENSITIVE, False, "contains(lower(scope), 'part4')"),
    ("pattern_smartcase", ["top9"], Case.SMART, False, "contains(lower(scope), 'top9')"),
    ("pattern_word", ["get"], Case.SENSITIVE, True, r"regexp_matches(scope, '(^|\W)(?:get)(\W|$)')"),
    ("pattern_escape", ["Part4"], Case.SENSITIVE, True, r"regexp_matches(scope, '(^|\W)Part4(\W|$)')"),
    ("pattern_all", [r"\w*"], Case.SENSITIVE, False, "true"),
]:
    _on_defs(_name, f"SELECT {ALL_COLUMNS} FROM defs WHERE {_where}", lambda d, p=_patterns, c=_case, w=_word: ops.by_pattern(d, [Pattern.parse(x, c, w) for x in p]))

DEPTH = r"len(regexp_extract_all(scope, '(::|[.\\])')) + 1"
_on_defs("scope_depth", f"SELECT {ALL_COLUMNS} FROM defs WHERE {DEPTH} <= 2", lambda d: ops.by_depth(d, 2))
_on_defs("scope_depth_hist", f"SELECT CAST({DEPTH} AS INTEGER) AS depth, count(*) AS n FROM defs GROUP BY 1", lambda d: d.groupBy(text.scope_depth(F.col("scope")).alias("depth")).agg(F.count("*").alias("n")))
_ANTI = "NOT (kind IN ('getter', 'setter') AND EXISTS (SELECT 1 FROM {t} b WHERE b.path = a.path AND b.line_start = a.line_start AND b.scope = a.scope AND b.kind IN ('property', 'subscript')))"
# Properties, subscripts and classes get a getter and a setter on their own line; every third setter is on the next one.
_ACCESSED, _MOVED = ["property", "subscript", "class"], "CASE WHEN kind = 'setter' AND ordinal % 3 = 0 THEN 1 ELSE 0 END"


def _with_accessors(defs: DataFrame) -> DataFrame:
    more = [defs.filter(F.col("kind").isin(_ACCESSED)).withColumn("kind", F.lit(kind)) for kind in ("getter", "setter")]
    more = [d.withColumn("line_start", F.expr(f"line_start + {_MOVED}")) for d in more]
    return defs.unionByName(more[0]).unionByName(more[1])


_on_defs(
    "accessor_dedup",
    f"""SELECT {ALL_COLUMNS} FROM (
        SELECT {ALL_COLUMNS} FROM defs
        UNION ALL SELECT * REPLACE (CAST(line_start + {_MOVED} AS INTEGER) AS line_start) FROM (
            SELECT {ALL_COLUMNS.replace("kind", "unnest(['getter', 'setter']) AS kind")} FROM defs WHERE kind IN ({_in(_ACCESSED)}))) a
        WHERE {_ANTI.format(t="defs")}""",
    lambda d: ops.without_accessors(_with_accessors(d)),
)
_FLAGSHIP = model.resolve(["callable", "value"])
SQL["combined_search"] = (
    f"WITH {derived.SQL}, m AS (SELECT * FROM defs WHERE kind IN ({_in(_FLAGSHIP)}) AND (contains(scope, 'Part1') OR contains(scope, 'Top')) AND {DEPTH} <= 3), "
    f"k AS (SELECT * FROM m a WHERE {_ANTI.format(t='m')}) SELECT {ALL_COLUMNS}, CAST(row_number() OVER (ORDER BY string_split(path, '/'), ordinal) AS INTEGER) AS place FROM k"
)


def combined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, pattern and depth filters, accessors dropped, in path order; ``place`` makes the order part of the rows."""
    from pyspark.sql import Window

    found = ops.search(derived.defs(spark, sf_dir), [Pattern.parse("Part1"), Pattern.parse("Top")], ["callable", "value"], depth=3)
    return found.withColumn("place", F.row_number().over(Window.orderBy(text.path_order(F.col("path")), "ordinal")))


QUERIES["combined_search"] = combined_search
_on_defs("path_sort", "SELECT path, CAST(row_number() OVER (ORDER BY string_split(path, '/')) AS INTEGER) AS place FROM (SELECT DISTINCT path FROM defs)", lambda d: _placed(ops.files(d)))
_on_defs("outline_containment", f"SELECT {ALL_COLUMNS}, line_end <= coalesce(max(line_end) OVER (PARTITION BY path ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS contained FROM defs", ops.outline)
_on_defs("count_per_file", "SELECT path, count(*) AS n FROM defs GROUP BY path", ops.counts)
_on_defs("files_with_matches", "SELECT DISTINCT path FROM defs", ops.files)
_on_defs("summary", "SELECT CAST(count(*) AS BIGINT) AS matched, count(DISTINCT path) AS files, CAST(0 AS BIGINT) AS errors FROM defs", ops.summary)
_on_defs("head_limit_files", f", c AS (SELECT path, sum(count(*)) OVER (ORDER BY string_split(path, '/')) AS s FROM defs GROUP BY path) SELECT {ALL_COLUMNS} FROM defs WHERE path IN (SELECT path FROM c WHERE s <= 300)", lambda d: ops.head(d, 300))
_on_defs("head_limit_rows", f"SELECT {ALL_COLUMNS} FROM defs ORDER BY string_split(path, '/'), ordinal LIMIT 25", lambda d: ops.head(d, 25, "rows"))
_on_defs("truncate_display", "SELECT path, ordinal, CASE WHEN strlen(signature) > 256 THEN left(signature, 256) || ' [truncated]' ELSE signature END AS signature FROM defs", lambda d: d.select("path", "ordinal", text.shown(F.col("signature")).alias("signature")))
_on_defs("truncate_storage", "SELECT path, ordinal, left(signature, 1024) AS signature FROM defs", lambda d: ops.stored(d).select("path", "ordinal", "signature"))
_on_defs("normalise_signature", r"SELECT path, ordinal, regexp_replace(regexp_replace(trim(regexp_replace(signature, '\s+', ' ', 'g')), ' ?\( ?', '(', 'g'), ' \)', ')', 'g') AS signature FROM defs", lambda d: d.select("path", "ordinal", text.normalised(F.col("signature")).alias("signature")))
_RANGE = "CASE WHEN line_start = line_end THEN CAST(line_start AS VARCHAR) ELSE CAST(line_start AS VARCHAR) || '-' || CAST(line_end AS VARCHAR) END"
_on_defs("render_lines", f"SELECT path, ordinal, path || ':' || {_RANGE} || ' [' || kind || '/' || scope || '] ' || CASE WHEN strlen(signature) > 256 THEN left(signature, 256) || ' [truncated]' ELSE signature END AS line FROM defs", ops.lines)
_on_defs(
    "ndjson",
    """, e AS (SELECT path, 0 AS rank, 0 AS ordinal, '{"type":"begin","data":{"path":"' || path || '"}}' AS json FROM (SELECT DISTINCT path FROM defs)
        UNION ALL SELECT path, 2, 0, '{"type":"end","data":{"path":"' || path || '","matched":' || CAST(count(*) AS VARCHAR) || '}}' FROM defs GROUP BY path
        UNION ALL SELECT NULL, 3, 0, '{"type":"summary","data":{"matched":' || CAST(count(*) AS VARCHAR) || ',"files":' || CAST(count(DISTINCT path) AS VARCHAR) || ',"errors":0}}' FROM defs
        UNION ALL SELECT path, 1, ordinal, '{"type":"match","data":{"path":"' || path || '","line_start":' || CAST(line_start AS VARCHAR) || ',"line_end":' || CAST(line_end AS VARCHAR) || ',"kind":"' || kind || '","scope":"' || scope || '","signature":"' || signature || '"}}' FROM defs)
        SELECT path, CAST(rank AS INTEGER) AS rank, CAST(ordinal AS INTEGER) AS ordinal, json FROM e""",
    ops.ndjson,
)
_on_defs("glob_include", r"SELECT DISTINCT path FROM defs WHERE regexp_matches(path, '^(.*/)?[^/]*\.py$') AND NOT regexp_matches(path, '^pkg3(/.*)?$')", lambda d: ops.files(d).filter(globs.selected(F.col("path"), ["*.py", "!/pkg3"])))
_on_defs("glob_exclude", r"SELECT DISTINCT path FROM defs WHERE NOT regexp_matches(path, '^(.*/)?sub/[^/]*\.rs$')", lambda d: ops.files(d).filter(globs.selected(F.col("path"), ["!**/sub/*.rs"])))
_on_defs("ignore_rules", r"SELECT DISTINCT path FROM defs WHERE NOT (regexp_matches(path, '^pkg1/(.*/)?sub/') OR (regexp_matches(path, '\.lua$') AND NOT regexp_matches(path, '(^|/)mod4\.lua$')))", lambda d: ops.files(d).filter(~globs.ignored(F.col("path"), [("", "*.lua"), ("", "!mod4.lua"), ("pkg1", "sub/")])))
_on_defs("hidden_filter", "SELECT DISTINCT path FROM defs WHERE NOT starts_with(path, '.') AND NOT contains(path, '/.')", lambda d: ops.files(d).filter(~text.hidden(F.col("path"))))
_on_defs("max_depth", "SELECT DISTINCT path FROM defs WHERE len(string_split(path, '/')) <= 2", lambda d: ops.files(d).filter(F.size(text.path_order(F.col("path"))) <= 2))
_on_defs("ext_filter", f"SELECT DISTINCT path FROM defs WHERE regexp_extract(path, '[.]([a-z]+)$', 1) IN ({_in(languages.extensions_for(['interface'], ['go', 'rust', 'c++']))})", lambda d: ops.files(d).filter(text.extension(F.col("path")).isin(languages.extensions_for(["interface"], ["go", "rust", "c++"]))))
_on_defs("path_relative", "SELECT DISTINCT CASE WHEN starts_with(path, 'pkg2/') THEN substr(path, 6) ELSE path END AS path FROM defs", lambda d: d.select(text.relative(F.col("path"), "pkg2").alias("path")).distinct())
_ROUTES = "(VALUES ('py', 'python'), ('go', 'go'), ('rs', 'rust'), ('h', '{h}'), ('lua', '{lua}')) AS r(ext, language)"
for _name, _hints, _h, _lua in [("route_language", [], "cplusplus", "lua"), ("route_hint", ["obj-c", "luau"], "objc", "luau")]:
    _on_defs(_name, f"SELECT DISTINCT path, language FROM defs JOIN {_ROUTES.format(h=_h, lua=_lua)} ON regexp_extract(path, '[.]([a-z]+)$', 1) = ext", lambda d, h=_hints: ops.files(d).withColumn("language", languages.routed(text.extension(F.col("path")), h)))


def _placed(files: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return files.withColumn("place", F.row_number().over(Window.orderBy(text.path_order(F.col("path")))))


# ---- stored results, simulated by the state of ``events`` before and after ----
_OLD, _NEW = "event_id % 10 < 8", "event_id % 10 > 0 AND user_id % 9 > 0"
_STATES = "WITH " + derived.FILES_SQL.format(where=_OLD).replace("f AS", "old AS", 1) + ", " + derived.FILES_SQL.format(where=_NEW).replace("f AS", "new AS", 1)


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.looked_up(derived.files(spark, sf_dir, _NEW), derived.files(spark, sf_dir, _OLD))


def cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = derived.files(spark, sf_dir, _OLD), derived.files(spark, sf_dir, _NEW)
    missed = ops.looked_up(new, old).filter("status <> 'hit'").drop("status")
    return ops.merged(old, missed, missed)


def cache_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.vacuumed(derived.files(spark, sf_dir, _OLD), derived.files(spark, sf_dir, _NEW))


QUERIES |= {f.__name__: f for f in (cache_lookup, cache_merge, cache_vacuum)}
SQL["cache_lookup"] = f"{_STATES} SELECT new.*, CASE WHEN old.path IS NULL THEN 'missing' WHEN old.mtime_ms = new.mtime_ms AND old.size = new.size THEN 'hit' ELSE 'stale' END AS status FROM new LEFT JOIN old ON new.path = old.path"
SQL["cache_merge"] = f"{_STATES}, missed AS (SELECT new.* FROM new LEFT JOIN old ON new.path = old.path AND old.mtime_ms = new.mtime_ms AND old.size = new.size WHERE old.path IS NULL) SELECT * FROM old WHERE path NOT IN (SELECT path FROM missed) UNION ALL SELECT * FROM missed"
SQL["cache_vacuum"] = f"{_STATES} SELECT * FROM old WHERE path IN (SELECT path FROM new)"


def kinds_to_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, e) for k in model.KINDS for e in languages.extensions_for([k])]
    table = spark.createDataFrame(rows, "kind string, ext string")
    return derived.defs(spark, sf_dir).select("kind").distinct().join(F.broadcast(table), "kind")  # a fixed table


QUERIES["kinds_to_ext"] = kinds_to_ext
SQL["kinds_to_ext"] = f"WITH {derived.SQL} SELECT DISTINCT d.kind, e.ext FROM defs d JOIN (VALUES " + ", ".join(f"('{k}', '{e}')" for k in model.KINDS for e in languages.extensions_for([k])) + ") AS e(kind, ext) ON d.kind = e.kind"
QUERIES |= extraction.QUERIES
SQL |= extraction.SQL


def rpc_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error codes of request frames made from events."""
    from ..streaming.requests import parsed

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    frame = F.expr("""CASE event_id % 4 WHEN 0 THEN '{"jsonrpc":"2.0","id":1,"method":"ping"}' WHEN 1 THEN '{"id":1,"method":"ping"}'
        WHEN 2 THEN '{"jsonrpc":"2.0","id":1,"method":"' || event_type || '"}' ELSE '{"jsonrpc":' END""")
    return parsed(events.select("event_id", frame.alias("value"))).groupBy(F.coalesce("code", F.lit(0)).alias("code")).agg(F.count("*").alias("n"))


QUERIES["rpc_dispatch"] = rpc_dispatch
SQL["rpc_dispatch"] = "SELECT CAST(CASE event_id % 4 WHEN 1 THEN -32600 WHEN 2 THEN -32601 WHEN 3 THEN -32700 ELSE 0 END AS INTEGER) AS code, count(*) AS n FROM events GROUP BY 1"
