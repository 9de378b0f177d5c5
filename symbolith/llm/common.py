"""What the operators of this package share: reading tables, staging results, and joins that a hot key can't stall."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Keys with more than this share of all rows are hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 2000
#: ... and more than so many rows.
HOT_ROWS = 1000
#: Rows of an Arrow batch that are turned into Python strings together.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in a single process, one of our own where it is
    unset."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: cuts the lineage, survives lost executors.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def width(rows: int) -> int:
    """Partitions of a staged table of so many short rows; without that a small table gets as many as a large one."""
    return 8 + rows // 100_000


def text_of(column: Column | str) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def quoted(name: str) -> str:
    """A column's name as an expression that means this column, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def _unordered(df: DataFrame, name: str) -> bool:
    """Whether the column's type has no order."""
    kind = df.schema[name].dataType.simpleString()
    return "map<" in kind or "variant" in kind


def only(df: DataFrame, id_col: str, digest: Column, kept: DataFrame) -> DataFrame:
    """The rows of ``df``, all their columns, whose id and ``digest`` are in ``kept`` (id, digest); of rows that repeat
    both, the one whose further columns are least (maps by their JSON)."""
    rest = {c: F.col(quoted(c)) for c in df.columns if c != id_col}
    own = df.select(F.col(quoted(id_col)).alias("own_id"), digest.alias("own_digest"), F.struct(*(x.alias(c) for c, x in rest.items())).alias("row"), F.struct(*(F.to_json(F.struct(x.alias("x"))) if _unordered(df, c) else x for c, x in rest.items())).alias("order"))
    least = F.min_by("row", "order") if any(_unordered(df, c) for c in rest) else F.min("row")
    single = own.groupBy("own_id", "own_digest").agg(least.alias("row"))
    match = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_digest") == F.col("digest"))
    found = single.join(kept.hint("merge"), match, "left_semi")
    return found.select(*[(F.col("row").getField(c) if c in rest else F.col("own_id")).alias(c) for c in df.columns])


def texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def runs(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column in runs of about ``limit`` characters, each with the row of its first."""
    at, run, size = 0, [], 0
    for k in range(0, batch.num_rows, SLICE):  # not all texts of the batch at once
        for j, t in enumerate(texts(batch.column(column).slice(k, SLICE)), k):
            if run and size + len(t) > limit:
                yield at, run
                at, run, size = j, [], 0
            run.append(t)
            size += len(t) + 1
    if run:
        yield at, run


def returning(run: Callable) -> Callable:
    """``run`` over batches, which then gives the memory that they took back to the system: workers live on beside the
    JVM."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # where the C library has it
            trim(0)

    return whole


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``counts`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
