"""Byte-level BPE encoding and decoding of whole texts.

Boundaries come from code-point classes and a transition-function scan (``pretoken``), merges from a bounded cache of
pre-tokens; ids and the offsets of their bytes come from flat arrays by gathering.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str, digests: bool = False) -> DataFrame:
    """One row per input row: the id, ``ids`` (array of int), ``offsets`` (array of int: byte at which each id begins).

    With ``digests`` instead of the arrays: n_tokens, ids_sha256 (of ids as little-endian unsigned 32-bit integers) and
    decoded_sha256 (of the bytes that the ids decode to), computed while the ids are at hand.  Null texts count as
    empty: no ids.  Null or repeated ids and further columns don't matter.  No shuffle.
    """

    def run(batches):
        codec = bpe.codec(vocabulary)
        for batch in batches:
            cols = [[], [], []]
            for _, texts in common.runs(batch, 1, 1 << 20):
                ids, counts = codec.encode(texts)
                data, lengths = codec.decode(ids)
                ends = np.cumsum(counts).tolist()
                offsets = np.cumsum(lengths) - lengths
                byte_ends = np.cumsum(common.sums(lengths, counts)).tolist()
                raw, decoded = memoryview(ids.astype("<u4").tobytes()), memoryview(data.tobytes())
                a = b = 0
                for end, byte_end in zip(ends, byte_ends):
                    if digests:
                        cols[0].append(end - a)
                        cols[1].append(hashlib.sha256(raw[4 * a : 4 * end]).hexdigest())
                        cols[2].append(hashlib.sha256(decoded[b:byte_end]).hexdigest())
                    else:
                        cols[0].append(ids[a:end])
                        cols[1].append((offsets[a:end] - b).astype(np.int32))
                    a, b = end, byte_end
            if digests:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.list_(pa.int32())), pa.array(cols[1], pa.list_(pa.int32()))], names=["id", "ids", "offsets"])

    rows = df.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, offsets array<int>"
    return rows.mapInArrow(common.returning(run), f"id {kind}, {columns}").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *, vocabulary: str) -> DataFrame:
    """One row per input row: the id and ``data``, the bytes (binary) that the ids decode to; null ids give none."""

    def run(batches):
        codec = bpe.codec(vocabulary)
        for batch in batches:
            out = [codec.decode(np.array(ids or [], np.int64))[0].tobytes() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "data"])

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(common.returning(run), f"id {rows.schema['id'].dataType.simpleString()}, data binary").withColumnRenamed("id", id_col)
