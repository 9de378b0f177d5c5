"""Best-fit packing of token sequences by the linear grouping scheme.

The plan depends on the histogram of piece lengths alone, at most ``capacity`` numbers, whatever the corpus:

1. lengths above a threshold are put in descending order and cut into groups of equal cardinality; each counts as long
   as the longest of its group, so only a few sizes are left;
2. configurations of these sizes (what fits into one sequence) are optimised by column generation: a linear program
   over the groups whose new columns come from a knapsack; its whole part is taken;
3. configurations with the longest sizes first, the actual lengths take the places of their groups, longest first; as
   actual lengths are shorter than their group counts for, the last place of a configuration takes the longest large
   length that fits, whichever its group, and the first place the length of its group that leaves the least room then;
4. what is left of the large ones, then the small ones, go best-fit into the sequence with the least room that holds
   them; sequences of equal content are handled together as one with a multiplicity;
5. of the plans by some numbers of groups, and of best fit for all lengths in descending order, the one with the fewest
   sequences is used (one by configurations where best fit has as many).

A piece finds its place by its length and its rank among the pieces of that length; ranks are counted inside salted
shares of a length, so that a common length doesn't meet in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, common

#: Pieces longer than this share of a sequence are large.
LARGE = 1 / 8
#: Numbers of groups that are tried.
GROUPS = (64, 48, 32)
#: Pieces of one length that are ranked in one task at most, about; less if that is a large share of all.
RANKED_TOGETHER = 200_000


def groups_of(histogram: dict[int, int], parts: int) -> list[list[tuple[int, int]]]:
    """Lengths in descending order as (length, count), cut into groups of equal cardinality."""
    total = sum(histogram.values())
    quota = max(1, -(-total // parts))
    groups, room = [[]], quota
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not room:
                groups.append([])
                room = quota
            n = min(left, room)
            groups[-1].append((length, n))
            left, room = left - n, room - n
    return [g for g in groups if g]


def best_column(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest worth that fits: an unbounded knapsack."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    for c in range(int(sizes.min()), capacity + 1):
        value[c], choice[c] = value[c - 1], -1
        fits = sizes <= c
        gain = np.where(fits, value[np.where(fits, c - sizes, 0)] + worth, -1)
        k = int(gain.argmax())
        if gain[k] > value[c] + 1e-12:
            value[c], choice[c] = gain[k], k
    column, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            column[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return float(value[capacity]), column


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Configurations with whole multiplicities that cover no more than the demand, from the linear program's optimum."""
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        worth, column = best_column(sizes, inverse.sum(0).clip(0), capacity)
        if worth <= 1 + 1e-7:
            break
        amount, change = inverse @ demand, inverse @ column
        ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[:, int(ratio.argmin())] = column
    amount = np.linalg.solve(basis, demand)
    left, taken = demand.astype(np.int64).copy(), []
    for j in np.argsort(-amount):
        column = basis[:, j].astype(np.int64)
        used = column > 0
        n = min(int(amount[j] + 1e-9), int((left[used] // column[used]).min()) if used.any() else 0)
        if n > 0:
            taken.append((column, n))
            left -= n * column
    return taken


class Sequences:
    """Sequences by the room that is left in them, those of equal content together."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room, self.rooms = capacity, defaultdict(list), []

    def add(self, content: tuple[int, ...], n: int) -> None:
        room = self.capacity - sum(content)
        if not self.by_room[room]:
            insort(self.rooms, room)
        self.by_room[room].append((content, n))

    def count(self) -> int:
        return sum(n for held in self.by_room.values() for _, n in held)

    def best_fit(self, length: int, n: int) -> None:
        """Puts ``n`` pieces of one length, each where the least room is left."""
        while n:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):  # new ones
                each = self.capacity // length
                if n >= each:
                    self.add((length,) * each, n // each)
                if n % each:
                    self.add((length,) * (n % each), 1)
                return
            room = self.rooms[at]
            content, have = self.by_room[room].pop()
            if not self.by_room[room]:
                self.rooms.pop(at)
            each = min(room // length, n)
            full = min(have, n // each)
            if have > full:
                self.add(content, have - full)
            self.add(content + (length,) * each, full)
            n -= full * each


def by_configurations(large: dict[int, int], capacity: int, groups: int) -> tuple[Sequences, dict[int, int]]:
    """Sequences of the optimised configurations, and how many pieces of each large length are left."""
    parts, members, demand = groups_of(large, groups), defaultdict(set), defaultdict(float)
    for part in parts:  # equal sizes are one row of the program
        size = part[0][0]
        members[size].update(x for x, _ in part)
        demand[size] += sum(n for _, n in part)
    sizes = np.array([*demand], np.int64)
    chosen = [(sorted(np.repeat(sizes, column).tolist(), reverse=True), n) for column, n in configurations(sizes, np.array([*demand.values()]), capacity)]
    lengths = {size: sorted(own, reverse=True) for size, own in members.items()}
    left, known, sequences = dict(large), sorted(large), Sequences(capacity)

    def instance(places: list[int], first: int) -> tuple[int, Counter]:
        """Room that is left and actual lengths, if the first place takes ``first``."""
        taken, room = Counter([first]), capacity - first
        for k, size in enumerate(places[1:], 2):
            own = reversed(known[: bisect_right(known, room)]) if k == len(places) else (x for x in lengths[size] if x <= room)
            if (found := next((x for x in own if left[x] > taken[x]), None)) is None:
                break
            taken[found] += 1
            room -= found
        return room, taken

    for places, n in sorted(chosen, reverse=True):
        # instances in a row whose actual lengths are the same; each turn uses up a length or the configuration
        while n and (options := [x for x in lengths[places[0]] if left[x]]):
            _, taken = min((instance(places, x) for x in options), key=lambda found: found[0])
            times = min(n, *(left[x] // k for x, k in taken.items()))
            sequences.add(tuple(sorted(taken.elements(), reverse=True)), times)
            for x, k in taken.items():
                left[x] -= k * times
                if not left[x]:
                    known.remove(x)
            n -= times
    return sequences, left


def packed(histogram: dict[int, int], capacity: int, groups: tuple[int, ...] = GROUPS) -> tuple[Sequences, int]:
    """The best of the plans, and how many pieces configurations have placed in it."""
    histogram = {x: n for x, n in histogram.items() if x > 0 and n}
    large = {x: n for x, n in histogram.items() if LARGE * capacity < x}
    plain = Sequences(capacity)
    for length in sorted(histogram, reverse=True):
        plain.best_fit(length, histogram[length])
    if not large:
        return plain, 0
    plans = []
    for k in groups:
        sequences, left = by_configurations(large, capacity, k)
        rest = histogram | left
        for length in sorted(rest, reverse=True):
            sequences.best_fit(length, rest[length])
        plans.append((sequences, sum(large.values()) - sum(left.values())))
    return min([*plans, (plain, 0)], key=lambda p: p[0].count())


def plan(histogram: dict[int, int], capacity: int, groups: tuple[int, ...] = GROUPS) -> np.ndarray:
    """Places by (length, rank): rows of length, first rank, rank behind the last, first sequence, offset.

    Each turn of planning uses up a length, a configuration or a kind of sequence, so the rows are some thousands for
    a capacity of 1024 however many pieces there are.
    """
    sequences, _ = packed(histogram, capacity, groups)
    rows, rank, first = [], defaultdict(int), 0
    for room in sorted(sequences.by_room):
        for content, n in sequences.by_room[room]:
            offset = 0
            for length in content:
                rows.append((length, rank[length], rank[length] + n, first, offset))
                rank[length] += n
                offset += length
            first += n
    assert all(rank[x] == n for x, n in histogram.items() if x > 0 and n)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(df: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids, each with its length, start and checksum; all rows are small."""

    def run(batches):
        codec, nth = bpe.codec(vocabulary), 0
        for batch in batches:
            row, cols = [], [[] for _ in range(5)]
            for at, texts in common.runs(batch, 1, 1 << 20):
                ids, counts = codec.encode(texts)
                ends = np.cumsum(counts)
                whole = np.insert(ids, ends, end_id).astype("<u4")  # the end id goes behind each document
                raw, begin = memoryview(whole.tobytes()), 0
                for k, n in enumerate((counts + 1).tolist()):
                    first = n % capacity or capacity  # only the first piece may be shorter
                    start = 0
                    for piece in range(-(-n // capacity)):
                        size = capacity if piece else first
                        place = begin + start
                        row.append(at + k)
                        for c, x in zip(cols, (piece, start, size, zlib.crc32(raw[4 * place : 4 * (place + size)]), nth)):
                            c.append(x)
                        nth += 1
                        start += size
                    begin += n
            own = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])]
            yield pa.RecordBatch.from_arrays(own, names=["id", "piece", "start", "length", "ids_crc32", "nth"])

    rows = df.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    return rows.mapInArrow(common.returning(run), f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, nth long")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; one longer than ``capacity`` is cut, the first piece being the shorter one.
    Null and empty texts are one piece of one id; rows with null or repeated ids are documents of their own; an empty
    table gives no rows; further columns are ignored.  Pieces are staged once; only the histogram of lengths (at most
    ``capacity`` rows) and the plan made from it pass the driver.
    """
    spark = df.sparkSession
    cut = common.staged(pieces(df, id_col, text_col, vocabulary, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = plan(histogram, capacity)
    # Ranks: rows of a length are dealt into salted shares, counted inside each, and set off by the shares before.
    together = min(RANKED_TOGETHER, max(common.HOT_ROWS, int(sum(histogram.values()) * common.HOT_SHARE)))
    shares = spark.createDataFrame([(x, -(-n // together)) for x, n in histogram.items()] or [(0, 1)], "length long, shares long")
    dealt = cut.join(F.broadcast(shares), "length").withColumn("share", F.expr("pmod(xxhash64(id, piece, start, nth), shares)")).drop("shares")
    window = Window.partitionBy("length", "share")
    ranked = dealt.withColumn("rank", F.row_number().over(window.orderBy("id", "piece", "ids_crc32", "nth")) - 1)
    sizes = dealt.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = ranked.join(offsets, ["length", "share"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    key = places[:, 0] << 42 | places[:, 1]
    sent = spark.sparkContext.broadcast((key, places[:, 3] - places[:, 1], places[:, 4]))

    def place(batches):
        keys, first, offset = sent.value
        for batch in batches:
            rank = batch.column(5).to_numpy()
            at = np.searchsorted(keys, batch.column(3).to_numpy() << 42 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first[at] + rank), pa.array(offset[at])], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = cut.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(common.returning(place), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
