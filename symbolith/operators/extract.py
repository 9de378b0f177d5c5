"""The extraction operator: rows of files to rows of definitions, or of errors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..extract.registry import EXTRACTORS
from ..session import ship
from . import relational

_ROWS = f"{model.DEFS}, message string"


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions and errors of files (path, language, content).

    A file that isn't UTF-8 is a read error; one that its extractor can't read is a parse error; both have no
    definitions.  Signatures are cut to what is stored.  One pass over Arrow batches, no shuffle.
    """
    ship(files.sparkSession)

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    found = EXTRACTORS[language]((content or b"").decode("utf-8").replace("\r\n", "\n"))
                    rows = [(path, k, language, d.kind, d.line_start, d.line_end, d.scope, d.signature, None) for k, d in enumerate(found)]
                except UnicodeDecodeError:
                    rows = [(path, None, language, "read", None, None, None, None, "stream did not contain valid UTF-8")]
                except (IndexError, ValueError, AttributeError, RecursionError) as e:
                    rows = [(path, None, language, "parse", None, None, None, None, f"failed to parse: {type(e).__name__}")]
                for row in rows:
                    for c, x in zip(cols, row):
                        c.append(x)
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["path", "ordinal", "language", "kind", "line_start", "line_end", "scope", "signature", "message"])

    rows = files.select("path", "language", "content").mapInArrow(run, _ROWS)
    defs = relational.stored(rows.filter(F.col("message").isNull()).drop("message"))
    errors = rows.filter(F.col("message").isNotNull()).select("path", F.col("kind").alias("phase"), "message")
    return defs, errors


def definitions_of(sources: DataFrame) -> DataFrame:
    """Definitions of rows (path, language, source), the source as text."""
    return extract(sources.withColumn("content", F.encode(F.col("source"), "UTF-8")))[0]


