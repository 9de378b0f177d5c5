"""Tables of definitions derived from the benchmark tables, in Spark and in SQL for the oracle.

The benchmark tables hold no source code; each row of ``part`` becomes a definition whose path, kind, scope, lines and
signature follow from its columns.  Both engines evaluate the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model

FILE = "'mod' || cast(p_partkey % 11 AS {s}) || CASE p_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.rs' WHEN 3 THEN '.h' ELSE '.lua' END"
COLUMNS = {
    "path": "CASE WHEN p_partkey % 13 = 0 THEN '.cache/' WHEN p_partkey % 4 = 0 THEN 'pkg' || cast(p_partkey % 7 AS {s}) || '/sub/' ELSE 'pkg' || cast(p_partkey % 7 AS {s}) || '/' END || " + FILE,
    "scope": "CASE p_partkey % 3 WHEN 0 THEN 'Part' || cast(p_size AS {s}) || '.' || lower(p_type) WHEN 1 THEN 'Part' || cast(p_size AS {s}) || '::' || lower(p_type) || '::get' ELSE 'Top' || cast(p_partkey % 100 AS {s}) END",
    "line_start": "cast(p_size * 3 + p_partkey % 17 AS {i})",
    "line_end": "cast(p_size * 3 + p_partkey % 17 + p_size % 9 AS {i})",
    "signature": "'def ' || p_name || '( ' || p_type || ' )' || CASE WHEN p_partkey % 10 = 0 THEN repeat('xy ', 420) ELSE '' END",
}
KINDS = "[" + ", ".join(f"'{k}'" for k in model.KINDS) + "]"
#: The derived table as a common table expression for the oracle.
SQL = (
    "d0 AS (SELECT p_partkey, "
    + ", ".join(f"{e.format(s='VARCHAR', i='INTEGER')} AS {c}" for c, e in COLUMNS.items())
    + f", {KINDS}[1 + p_partkey % {len(model.KINDS)}] AS kind FROM part), "
    "defs AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY p_partkey) AS INTEGER) AS ordinal, kind, line_start, line_end, scope, signature FROM d0)"
)


def defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    kind = F.element_at(F.array(*[F.lit(k) for k in model.KINDS]), (F.col("p_partkey") % len(model.KINDS) + 1).cast("int"))
    rows = part.select("p_partkey", *[F.expr(e.format(s="STRING", i="INT")).alias(c) for c, e in COLUMNS.items()], kind.alias("kind"))
    ordinal = F.row_number().over(Window.partitionBy("path").orderBy("p_partkey"))
    return rows.select("path", ordinal.alias("ordinal"), "kind", "line_start", "line_end", "scope", "signature")


#: State of a tree by ``events``: one file a user, its last event's time and number of events as time and size.
FILES_SQL = "f AS (SELECT 'u' || CAST(user_id AS VARCHAR) || '.py' AS path, CAST(max(event_id) AS BIGINT) AS mtime_ms, count(*) AS size FROM events WHERE {where} GROUP BY user_id)"


def files(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter(where)
    rows = events.groupBy("user_id").agg(F.max("event_id").alias("mtime_ms"), F.count("*").alias("size"))
    return rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"), "mtime_ms", "size")
