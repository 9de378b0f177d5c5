"""Exact top-k search by inner product with norm-bucketed retrieval.

Vectors become integers and are grouped by length (Euclidean norm) into buckets, longest first.  A query's own bucket,
which has its copies, and a first pass over the buckets of the longest vectors give it a lower bound of its k-th best
score.  In the second pass blocks of queries meet the buckets, the longest first, and each query's bound rises with the
best that it has met.
bound / (length of the query * greatest length of the bucket) is the cosine that a vector of the bucket must reach.
Above 1 the bucket is skipped; near 1 the largest coordinates of the query prune through sorted lists of the bucket's
coordinates, as a vector of that cosine can't be far from it in any of them; otherwise the vectors' lengths prune.  What
remains is verified by products.

Queries and buckets meet in cells, a group of queries by a group of buckets: a task gets its queries, keeps them with
their k best, and then reads its buckets one by one.  So no row ever holds a pair of a block and a bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors of a bucket and queries of a block at most, and bytes of either.
BUCKET, QUERIES, BLOCK_BYTES = 4096, 1024, 1 << 20
#: Bytes of the queries of a cell, with what is kept of each, and of its buckets.
CELL_QUERIES, CELL_BUCKETS = 24 << 20, 32 << 20
#: Share of the vectors that the first pass reads.
FIRST = 1 / 32
#: Local cosine from which coordinates prune, how many of them, the share of a bucket that they may leave, and products
#: of numbers that are worth sorting a coordinate.
COORDINATES_FROM, COORDINATES, LEFT, LIST_WORTH = 0.6, 4, 1 / 16, 1024
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_VECTOR = "id long, dim int, width int, norm double, data binary"
_BLOCK = "dim int, width int, n int, longest double, ids binary, data binary, bound binary"
_FOUND = "block long, row int, query_id long, id long, score long"


def _floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; what is beyond them becomes the nearest."""
    with np.errstate(over="ignore"):
        f = np.floor(x.astype(np.float64) * scale)
    inside = np.clip(f, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
    return np.where(f >= 2.0**63, MOST, inside)


def _vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """The rows that take part: id, dimension, bytes of a number (2, 4, 8), square of the length, numbers."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            dims = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            x = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
            starts = np.concatenate([[0], np.cumsum(dims)])
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            usable = wrong[starts[1:]] == wrong[starts[:-1]]
            for dim in np.unique(dims[usable]).tolist():
                of = np.flatnonzero(usable & (dims == dim))
                v = _floors(x[starts[of][:, None] + np.arange(dim)], scale)
                low, high = (v.min(1), v.max(1)) if dim else (np.zeros(len(of)), np.zeros(len(of)))
                widths = np.where((low >= -(2**15)) & (high < 2**15), 2, np.where((low >= -(2**31)) & (high < 2**31), 4, 8))
                for width in np.unique(widths).tolist():
                    at = np.flatnonzero(widths == width)
                    n, ends = len(at), np.arange(len(at) + 1, dtype=np.int32) * (dim * width)
                    data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(v[at].astype(f"<i{width}").tobytes())])
                    norm = (v[at].astype(np.float64) ** 2).sum(1)
                    columns = [pa.array(ids[of[at]], pa.int64()), pa.array(np.full(n, dim), pa.int32()), pa.array(np.full(n, width), pa.int32()), pa.array(norm, pa.float64()), data]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "dim", "width", "norm", "data"])

    v = F.col(vector_col)
    if df.schema[vector_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).mapInArrow(common.returning(run), _VECTOR)


def _packed(rows: DataFrame, every: int, k: int) -> DataFrame:
    """Buckets of vectors of one dimension and width, longest first; ``rows`` are in that order inside a partition.

    ``bound`` has what the bucket itself gives each of its queries as a bound.
    """
    size = BUCKET

    def run(batches):
        held: dict[tuple[int, int], tuple[list[int], list[bytes]]] = {}

        def bucket(dim: int, width: int):
            ids, vs = held.pop((dim, width))
            ids, data = np.array(ids, np.int64), np.frombuffer(b"".join(vs), f"<i{width}").reshape(len(ids), dim)
            longest, asked, bounds = float(_lengths(data).max()), np.flatnonzero(ids % every == 0), []
            whole = Bucket(ids, data, longest)
            for at in range(0, len(asked), QUERIES):
                of = asked[at : at + QUERIES]
                block = Block(0, ids[of], data[of], np.full(len(of), LEAST), k)
                block.meet(whole)
                bounds.append(block.reached().tobytes())
            return _row(dim, width, longest, ids.tobytes(), data.tobytes(), b"".join(bounds))

        for batch in batches:
            for i, dim, width, v in zip(*(batch.column(c).to_pylist() for c in ("id", "dim", "width", "data"))):
                ids, vs = held.setdefault((dim, width), ([], []))
                ids.append(i)
                vs.append(v)
                if len(ids) >= size or (len(ids) + 1) * len(v) > BLOCK_BYTES:
                    yield bucket(dim, width)
        for dim, width in list(held):
            yield bucket(dim, width)

    return rows.select("id", "dim", "width", "data").mapInArrow(common.returning(run), _BLOCK)


def _asked(buckets: DataFrame, every: int) -> DataFrame:
    """Blocks of the queries in the buckets, with their bounds."""
    size = QUERIES

    def run(batches):
        held: dict[tuple[int, int], list[tuple[bytes, bytes, bytes]]] = {}

        def block(dim: int, width: int):
            ids, data, bound = (b"".join(x) for x in zip(*held.pop((dim, width))))
            longest = float(_lengths(np.frombuffer(data, f"<i{width}").reshape(-1 if dim else len(ids) // 8, dim)).max())
            return _row(dim, width, longest, ids, data, bound)

        for batch in batches:
            for i in range(batch.num_rows):
                dim, width, ids, data, bound = (batch.column(c)[i].as_py() for c in ("dim", "width", "ids", "data", "bound"))
                ids, step = np.frombuffer(ids, np.int64), dim * width
                for n, j in enumerate(np.flatnonzero(ids % every == 0).tolist()):
                    of = held.setdefault((dim, width), [])
                    of.append((ids[j].tobytes(), data[j * step : (j + 1) * step], bound[8 * n : 8 * n + 8]))
                    if len(of) >= size or (len(of) + 1) * step > BLOCK_BYTES:
                        yield block(dim, width)
        for dim, width in list(held):
            yield block(dim, width)

    return buckets.select("dim", "width", "ids", "data", "bound").filter(F.length("bound") > 0).mapInArrow(common.returning(run), _BLOCK)


def _row(dim: int, width: int, longest: float, ids: bytes, data: bytes, bound: bytes) -> pa.RecordBatch:
    columns = ((dim, pa.int32()), (width, pa.int32()), (len(ids) // 8, pa.int32()), (longest, pa.float64()), (ids, pa.binary()), (data, pa.binary()), (bound, pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in columns], names=["dim", "width", "n", "longest", "ids", "data", "bound"])


def _lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype(np.float64) ** 2).sum(1))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point where it holds them, as no partial sum passes the lengths' product."""
    most = 1.001 * float(_lengths(q).max(initial=0)) * float(_lengths(c).max(initial=0))
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return q.astype(kind, copy=False) @ c.astype(kind, copy=False).T


class Bucket:
    """Vectors of one dimension in the order of their ids."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, longest: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.data, self.longest = ids[order], data[order], longest
        self.norms = _lengths(self.data)
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def unit(self, rows: np.ndarray, coordinate: np.ndarray | int) -> np.ndarray:
        return self.data[rows, coordinate] / np.where(self.norms[rows] > 0, self.norms[rows], 1)

    def missing(self, coordinates: np.ndarray) -> int:
        return sum(j not in self._lists for j in coordinates.tolist())

    def list_of(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        """The vectors in the order of a coordinate of their directions, and this coordinate."""
        if coordinate not in self._lists:
            unit = self.unit(np.arange(len(self.ids)), coordinate)
            order = np.argsort(unit)
            self._lists[coordinate] = order, unit[order]
        return self._lists[coordinate]


def _by_coordinates(q: np.ndarray, length: np.ndarray, limit: np.ndarray, cosine: np.ndarray, c: Bucket):
    """Which queries the coordinates leave few vectors, and the pairs (query's row, vector) that they leave these."""
    direction = q / length[:, None]
    focus = np.argsort(-np.abs(direction), axis=1)[:, :COORDINATES]
    largest = np.unique(focus[:, 0])
    if c.missing(largest) * LIST_WORTH > q.size:
        return np.zeros(len(q), bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
    d, least = np.take_along_axis(direction, focus, 1), np.minimum(cosine, 1.0)[:, None]
    width = np.sqrt(np.maximum(0, (1 - least**2) * (1 - d**2))) + 1e-9
    # cosine at least that: a coordinate is within [low, high], unless its own end of the sphere is nearer than that
    low = np.where(d < -least, -1.0, d * least - width) - 1e-9
    high = np.where(d > least, 1.0, d * least + width) + 1e-9
    start, end = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    for j in largest.tolist():
        of, at = np.flatnonzero(focus[:, 0] == j), c.list_of(j)[1]
        start[of], end[of] = np.searchsorted(at, low[of, 0], "left"), np.searchsorted(at, high[of, 0], "right")
    few = end - start <= len(c.ids) * LEFT
    rows, found = [], []
    for j in largest.tolist():
        of = np.flatnonzero(few & (focus[:, 0] == j))
        n = end[of] - start[of]
        row = np.repeat(of, n)
        rows.append(row)
        found.append(c.list_of(j)[0][np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + start[row]])
    row, vector = np.concatenate(rows), np.concatenate(found)
    kept = c.norms[vector] * length[row] >= limit[row] * (1 - 1e-9) - 1e-6
    row, vector = row[kept], vector[kept]
    for f in range(1, focus.shape[1]):
        unit = c.unit(vector, focus[row, f])
        kept = (unit >= low[row, f]) & (unit <= high[row, f])
        row, vector = row[kept], vector[kept]
    return few, row, vector


def _hits(q_ids: np.ndarray, q: np.ndarray, length: np.ndarray, bound: np.ndarray, c: Bucket, k: int):
    """(query's row, id, score) of what a bucket can add to the queries' k best, as three arrays; of a query with many
    such vectors the k best at least, ties by the smaller id."""
    limit, reach = bound.astype(np.float64), length * c.longest
    live = np.flatnonzero((bound == LEAST) | (limit <= reach * (1 + 1e-9) + 1e-6))
    cosine = np.where(reach[live] > 0, limit[live] / np.where(reach[live] > 0, reach[live], 1), -np.inf)
    sharp = (cosine >= COORDINATES_FROM) & (length[live] > 0)
    out = []
    if sharp.any():
        at = live[sharp]
        few, row, vector = _by_coordinates(q[at], length[at], limit[at], cosine[sharp], c)
        row = at[row]
        for k0 in range(0, len(row), 1 << 15):  # some pairs at a time
            r, v = row[k0 : k0 + (1 << 15)], vector[k0 : k0 + (1 << 15)]
            scores = np.einsum("ij,ij->i", q[r].astype(np.int64), c.data[v].astype(np.int64))
            may = (scores >= bound[r]) & (c.ids[v] != q_ids[r])
            out.append((r[may], c.ids[v[may]], scores[may]))
        live = np.setdiff1d(live, at[few], assume_unique=True)
    if len(live):
        # by length: no vector shorter than the least of what the queries need
        need = np.min(np.where((bound[live] > 0) & (length[live] > 0), limit[live] / np.where(length[live] > 0, length[live], 1), 0))
        enough = np.flatnonzero(c.norms >= need * (1 - 1e-9) - 1e-6)
        if len(enough):
            ids = c.ids[enough]
            rows, columns, scores = _reaching(_products(q[live], c.data[enough]), bound[live], ids, q_ids[live], k)
            out.append((live[rows], ids[columns], scores))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _reaching(scores: np.ndarray, bound: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """Places and values of the scores that reach their row's bound; ``ids`` rise."""
    exact = scores.dtype == np.int64
    least = bound if exact else np.where(bound == LEAST, -np.inf, bound).astype(scores.dtype)
    rows = np.flatnonzero(scores.max(1) >= least)
    scores, least = scores[rows], least[rows]
    may = scores >= least[:, None]
    many = np.flatnonzero(np.count_nonzero(may, axis=1) > 4 * k)
    if len(many):
        s = scores[many]
        first, end = (np.searchsorted(ids, own[rows[many]], side) for side in ("left", "right"))
        for i in np.flatnonzero(end > first).tolist():
            s[i, first[i] : end[i]] = LEAST if exact else -np.inf
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        may[many] = s >= np.maximum(kth, least[many])[:, None]
        for i in np.flatnonzero(np.count_nonzero(may[many], axis=1) > 4 * k).tolist():  # ties: the smallest ids
            may[many[i]] = s[i] > kth[i]
            may[many[i], np.flatnonzero(s[i] == kth[i])[:k]] = True
    row, column = np.nonzero(may)
    other = ids[column] != own[rows[row]]
    row, column = row[other], column[other]
    return rows[row], column, scores[row, column].astype(np.int64)


def _first(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best of each row, and their ranks from 0."""
    order = np.lexsort((ids, ~scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
    kept = rank < k
    return rows[kept], ids[kept], scores[kept], rank[kept]


def search_bucket(q_ids, q, bound, ids, data, longest: float, k: int):
    """(query's row, id, score) of what a bucket can add to the queries' k best, the k best of each query."""
    rows, found, scores, _ = _first(*_hits(q_ids, q, _lengths(q), bound, Bucket(ids, data, longest), k), k)
    return zip(rows.tolist(), found.tolist(), scores.tolist())


class Block:
    """Queries of one dimension with the k best that they have met."""

    def __init__(self, block: int, ids: np.ndarray, data: np.ndarray, bound: np.ndarray, k: int):
        self.block, self.ids, self.data, self.bound, self.k = block, ids, data, bound, k
        self.length = _lengths(data)
        self.n = np.zeros(len(ids), np.int64)
        self.found, self.score = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), LEAST)

    def meet(self, c: Bucket) -> None:
        full = self.n == self.k
        # a tie of the k-th counts by its id only
        past = full & (self.found[:, -1] < c.ids[0]) & (self.score[:, -1] < MOST)
        bound = np.maximum(self.reached(), np.where(full, self.score[:, -1] + past, LEAST))
        rows, ids, scores = _hits(self.ids, self.data, self.length, bound, c, self.k)
        if len(rows):
            touched = np.unique(rows)
            had = np.arange(self.k) < self.n[touched][:, None]
            rows = np.concatenate([rows, np.repeat(touched, self.n[touched])])
            rows, ids, scores, rank = _first(rows, np.concatenate([ids, self.found[touched][had]]), np.concatenate([scores, self.score[touched][had]]), self.k)
            self.found[rows, rank], self.score[rows, rank] = ids, scores
            self.n[touched] = np.bincount(rows, minlength=len(self.ids))[touched]

    def results(self) -> pa.RecordBatch:
        row, rank = np.nonzero(np.arange(self.k) < self.n[:, None])
        columns = (np.full(len(row), self.block), row.astype(np.int32), self.ids[row], self.found[row, rank], self.score[row, rank])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "row", "query_id", "id", "score"])

    def reached(self) -> np.ndarray:
        """The score that a query's k-th best has at least."""
        return np.where(self.n == self.k, np.maximum(self.bound, self.score[:, -1]), self.bound).astype(np.int64)

    def bounded(self) -> pa.RecordBatch:
        row = {"block": self.block, "bound": self.reached().tobytes()}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([("block", pa.int64()), ("bound", pa.binary())]))


def _meeting(queries: DataFrame, buckets: DataFrame, q_groups: int, b_groups: int, k: int, what: str, schema: str) -> DataFrame:
    """What each block of queries makes (``what``, a method of Block) of the buckets of a cell, in each of its cells."""

    def run(batches):
        cell, held = None, {}

        def made():
            for blocks in held.values():
                for b in blocks:
                    yield getattr(b, what)()

        for batch in batches:
            at = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                c, key, dim, width = (at[x][i].as_py() for x in ("cell", "key", "dim", "width"))
                if c != cell:
                    yield from made()
                    cell, held = c, {}
                ids = np.frombuffer(at["ids"][i].as_py(), np.int64)
                data = np.frombuffer(at["data"][i].as_py(), f"<i{width}").reshape(len(ids), dim)
                if at["kind"][i].as_py() == 0:
                    held.setdefault(dim, []).append(Block(key, ids, data, np.frombuffer(at["bound"][i].as_py(), np.int64), k))
                elif dim in held:
                    bucket = Bucket(ids, data, at["longest"][i].as_py())
                    for b in held[dim]:
                        b.meet(bucket)
        yield from made()

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def share(key: str, n: int):  # neighbours are dealt to different groups
        return F.pmod(F.shiftright(key, 33) + F.col(key).bitwiseAND((1 << 33) - 1), F.lit(n)).cast("int")

    columns = ["cell", "kind", "key", "dim", "width", "longest", "ids", "data", "bound"]
    left = queries.withColumn("b", every(b_groups)).withColumn("cell", share("block", q_groups) * b_groups + F.col("b")).withColumns({"kind": F.lit(0), "key": F.col("block")})
    right = buckets.withColumn("q", every(q_groups)).withColumn("cell", F.col("q") * b_groups + share("bucket", b_groups)).withColumns({"kind": F.lit(1), "key": F.col("bucket"), "bound": F.lit(None).cast("binary")})
    both = left.select(columns).unionByName(right.select(columns))
    dealt = both.repartitionById(q_groups * b_groups, F.col("cell")).sortWithinPartitions("cell", "kind", F.col("longest").desc(), "key")
    return dealt.mapInArrow(common.returning(run), schema)


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), id, score: the k best rows for each query, a row whose id is divisible by ``every``.

    Components are floor(scale * x); the score is their inner product, in 64 bits.  Ties go to the smaller id.  Rows
    without an id, and vectors that are null or hold null or non-finite components take no part; vectors meet those of
    their own number of components only; rows that share a query's id are not its candidates.  Fewer candidates than k
    give as many rows, none of them no row.  Repeated ids are candidates, or queries, one by one.

    Queries and buckets come to their cells by one shuffle, from staged tables; only the numbers of the first pass's
    buckets and the queries' bounds may be broadcast.
    """
    vectors = common.staged(_vectors(df, id_col, vector_col, scale), "vectors")
    is_query = F.pmod(F.col("id"), F.lit(every)) == 0
    size = F.col("dim").cast("long") * F.col("width")
    kept = size + 16 * k + 32
    n, n_queries, b_bytes, q_bytes = (x or 0 for x in vectors.agg(F.count("*"), F.count_if(is_query), F.sum(size + 8), F.sum(F.when(is_query, kept))).first())
    n_parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # ties of the norm are dealt by the id's hash, so that a common vector is spread as well
    ordered = vectors.repartitionByRange(max(8, n // (4 * BUCKET), b_bytes // CELL_BUCKETS), F.col("norm").desc(), F.xxhash64("id")).sortWithinPartitions(F.col("norm").desc(), "id")
    buckets = common.staged(_packed(ordered, every, k).withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    queries = common.staged(_asked(buckets, every).withColumn("block", F.monotonically_increasing_id()), "queries")

    # of each dimension the longest, with more than 10 * k vectors
    by_dim = Window.partitionBy("dim")
    before = F.coalesce(F.sum("n").over(by_dim.orderBy(F.col("longest").desc(), "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.greatest(F.lit(10.0 * k), F.sum("n").over(by_dim) * FIRST)
    first = buckets.select("dim", "n", "longest", "bucket").select("bucket", (before <= share).alias("in_first")).filter("in_first").select("bucket")
    top = buckets.join(F.broadcast(first), "bucket", "left_semi")
    q_groups = max(1, math.ceil(q_bytes / CELL_QUERIES))
    # the first pass has one group of buckets, so its queries are dealt to more tasks
    bounds = common.staged(_meeting(queries, top, max(q_groups, min(n_parts, math.ceil(n_queries / QUERIES), 4 * q_groups)), 1, k, "bounded", "block long, bound binary"), "bounds")
    sent = queries.drop("bound").join(bounds, "block")
    # cells enough for all cores, while the queries' copies stay below the buckets'
    b_groups = max(math.ceil(b_bytes / CELL_BUCKETS), min(math.ceil(n_parts / q_groups), b_bytes * q_groups // max(1, q_bytes), math.ceil(n / BUCKET)), 1)
    best = _meeting(sent, buckets, q_groups, b_groups, k, "results", _FOUND)
    window = Window.partitionBy("block", "row").orderBy(F.col("score").desc(), "id")
    ranked = best.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
