"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of equal size.  Blocks are dealt into buckets, sorted there, and get integer names: equal
blocks the same one, different blocks different ones.  Then neighbouring names form pairs, which are named in the same
way, until each text has a single name; that takes log2(blocks of the longest text) rounds.  Names of different rounds
come from disjoint ranges, so a name is a collision-free identity.  Hashes only choose the bucket.

A block or pair that many texts share would meet in one bucket.  Such hot keys (more than ``common.HOT_SHARE`` of all,
so a bounded number) are named beforehand from their distinct values, which is a small table that a broadcast holds;
their rows go to any bucket, without the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of a block.
BLOCK = 4096
#: Keys in a bucket, about; at most 2 ** 23 buckets.
BUCKET_KEYS = 4000
HOT_BUCKET = (1 << 24) - 1
#: White space that counts as one space (fixed), written to match only where a text changes.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(common.text_of(text), RUNS, " ")


def name_keys(rows: DataFrame, keys: list[str], level: int) -> DataFrame:
    """``rows`` with the integer ``name`` of their key instead of its columns; names of a level are its own."""
    hashed = rows.withColumn("h", F.xxhash64(*keys))
    total = Observation()
    counts = hashed.groupBy("h").agg(F.count("*").alias("n")).observe(total, F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    often = common.staged(counts.filter(F.col("n") > common.HOT_ROWS), "often")
    limit = max(common.HOT_ROWS, int(total.get["n"] * common.HOT_SHARE))
    hot = [r["h"] for r in often.filter(F.col("n") > limit).collect()]  # at most 1 / HOT_SHARE
    buckets = min(1 << 23, max(64, total.get["n"] // BUCKET_KEYS))
    bucket = F.pmod("h", F.lit(buckets))
    if hot:
        distinct = hashed.filter(F.col("h").isin(hot)).select(*keys).distinct()
        named = distinct.select(*keys, (F.dense_rank().over(Window.orderBy(*keys)) + ((level << 56) | (HOT_BUCKET << 32))).alias("hot_name"))
        hashed = hashed.join(F.broadcast(common.staged(named, "names")), keys, "left")
        known = F.col("hot_name").isNotNull()
        hashed = hashed.withColumn("bucket", F.when(known, F.pmod(F.xxhash64("id", "digest", "pos"), F.lit(buckets))).otherwise(bucket))
        hashed = hashed.withColumns({k: F.when(~known, F.col(k)) for k in keys})
    else:
        hashed = hashed.withColumns({"bucket": bucket, "hot_name": F.lit(None).cast("long")})
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*keys))
    name = F.lit(level << 56) + F.shiftleft("bucket", 32) + rank
    return hashed.drop("h").withColumn("name", F.coalesce("hot_name", name)).drop(*keys, "bucket", "hot_name")


def in_order(named: DataFrame, level: int) -> DataFrame:
    """The names of each text, by position; repeated rows (same id, same text) are one row with its ``copies``."""
    seen = F.collect_set(F.struct("pos", "name"))
    grouped = named.groupBy("id", "digest").agg(F.array_sort(seen).alias("names"), F.sum("copies").alias("rows"))
    names = grouped.select("id", "digest", F.expr("cast(rows div size(names) as long)").alias("copies"), F.expr("transform(names, x -> x.name)").alias("names"))
    return common.staged(names, f"level{level}")


def identities(df: DataFrame, id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """id, digest (SHA-256 of the normalised text), copies (rows with this id and text), name (the text's identity)."""
    data = df.select(F.col(id_col).alias("id"), normalised(text_col).alias("text"))
    data = data.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), F.col("text").cast("binary").alias("data"))
    cut = F.expr(f"transform(sequence(0, greatest(1, (octet_length(data) + {block - 1}) div {block}) - 1), i -> substring(data, cast(i * {block} + 1 as int), {block}))")
    blocks = data.select("id", "digest", F.lit(1).cast("long").alias("copies"), F.posexplode(cut).alias("pos", "block"))
    current, done, level = in_order(name_keys(blocks, ["block"], 0), 0), [], 0
    longest = current.agg(F.max(F.size("names"))).first()[0] or 1
    while True:
        done.append(current.filter(F.size("names") == 1).select("id", "digest", "copies", F.col("names")[0].alias("name")))
        if longest <= 1:
            break
        longest, level = (longest + 1) // 2, level + 1
        pairs = F.expr("transform(sequence(0, (size(names) + 1) div 2 - 1), i -> named_struct('a', names[cast(2 * i as int)], 'b', coalesce(get(names, cast(2 * i + 1 as int)), -1L)))")
        pairs = current.filter(F.size("names") > 1).select("id", "digest", "copies", F.posexplode(pairs).alias("pos", "pair"))
        pairs = pairs.select("id", "digest", "copies", "pos", "pair.a", "pair.b")
        current = in_order(name_keys(pairs, ["a", "b"], level), level)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, block: int = BLOCK) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space (space, tab to carriage return) has become one space;
    null counts as empty.  Of a group the row with the smallest id is kept, one row if that row is repeated; a null id
    is kept only where a group has no other.  An empty table gives no rows; further columns are ignored.
    """
    each = common.staged(identities(df, id_col, text_col, block), "identities")
    groups = common.staged(each.groupBy("name").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    joined = each.join(groups, "name").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, block: int = BLOCK) -> DataFrame:
    """The rows of ``df`` that ``exact_dedup`` keeps, all their columns: one row of each group of equal texts; of rows
    that repeat id and text the one whose further columns are least (``common.only``)."""
    kept = exact_dedup(df, id_col, text_col, block=block).filter("kept")
    kept = kept.select(F.col(common.quoted(id_col)).alias("id"), F.unhex("text_sha256").alias("digest"))
    return common.only(df, id_col, F.unhex(F.sha2(normalised(common.quoted(text_col)), 256)), kept)
