"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Signatures: a text is the set of its word shingles, of weight 1 each, so that candidates come from the similarity that
is verified (``weights`` has other schemes).  Each shingle sends arrivals
of an exponential race to the registers of the signature, in ascending order and each register once (spacings of the
order statistics); a register keeps the shingle that arrives first.  Shingles stop as soon as their next arrival is
later than every register's first, so most of them send few.  Two texts agree in a register with the probability
Jaccard similarity of their weighted sets.

Classes: texts of equal words are one node.  Signatures are cut into bands; nodes that share a band are candidates.
Candidates are verified by the exact Jaccard similarity of their shingle sets, and linked nodes form classes.  A large
bucket is never paired out.  In each round its open nodes are compared with their leader, the one that shares most
buckets with other nodes; those of the leader's class are closed.  When rounds link next to nothing more, nodes of
different classes in a bucket are compared if prefix filtering leaves them a chance; that is exact, so no link is lost.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: At a similarity of 0.8, 48 bands of 7 registers miss a pair with a probability of 1e-5.
BANDS, BAND_SIZE = 48, 7
#: Rounds of leaders go on while more than this share of what they compare is linked.
LEAST_YIELD = 0.02
#: Pairs of a node that are verified in one task, and the ratio of the sizes in one class.
PAIRS_TOGETHER, SIZE_STEP = 500, 1.03
#: A similarity that is less than the threshold by rounding only reaches it.
EVEN = 1e-9
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class _Words(dict):
    """64-bit hash of a word."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return got


@lru_cache(1)
def _words() -> _Words:
    return _Words()


def digest_of(text_col: str) -> Column:
    return F.unhex(F.sha2(common.text_of(text_col), 256))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def shingles(words: list[str], size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words; a shorter text is one shingle, an empty one none."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    total = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for k in range(min(size, len(words))):
        total = _mixed(total * GOLDEN + hashes[k : k + n])
    return total


def signatures(sets: list[np.ndarray], weights: list[np.ndarray], registers: int) -> np.ndarray:
    """[text, register]: the shingle that arrives first, 0 for an empty set."""
    sizes = np.array([len(s) for s in sets])
    won, first = np.zeros(len(sets) * registers, np.uint64), np.full(len(sets) * registers, np.inf)
    if not sizes.sum():
        return won.reshape(len(sets), registers)
    element, weight = np.concatenate(sets), np.concatenate(weights)
    text = np.repeat(np.arange(len(sets)), sizes)
    # A shingle's order of registers: an affine permutation of the prime above their number, the rest skipped.
    prime = next(p for p in range(registers, 2 * registers + 2) if all(p % d for d in range(2, int(p**0.5) + 1)))
    seed = _mixed(element + GOLDEN)
    at = (seed % np.uint64(prime)).astype(np.int64)
    step = (_mixed(seed) % np.uint64(prime - 1)).astype(np.int64) + 1
    time, left = np.zeros(len(element)), np.full(len(element), registers)
    for turn in range(prime):
        inside = at < registers
        if inside.any():
            draw = _mixed(element[inside] ^ np.uint64(int(GOLDEN) * (turn + 2) % 2**64))
            gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            time[inside] += gap / (weight[inside] * left[inside])
            left[inside] -= 1
            place, arrival = text[inside] * registers + at[inside], time[inside]
            early = arrival < first[place]
            place, arrival, who = place[early], arrival[early], element[inside][early]
            np.minimum.at(first, place, arrival)
            winner = first[place] == arrival
            won[place[winner]] = who[winner]
        at = (at + step) % prime
        if turn < 8 or turn % 4 == 0:
            last = first.reshape(len(sets), registers).max(1)
            alive = (time < last[text]) & (left > 0)
            if not alive.any():
                break
            if alive.sum() < 0.9 * len(alive):
                element, weight, text, at, step, time, left = (x[alive] for x in (element, weight, text, at, step, time, left))
    return won.reshape(len(sets), registers)


def bands_of(signature: np.ndarray, bands: int) -> np.ndarray:
    """[text, band]: hash of the band's registers and its number."""
    rows = signature.reshape(len(signature), bands, -1)
    total = np.broadcast_to(_mixed(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN), rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        total = _mixed(total * GOLDEN + rows[:, :, k])
    return total.view(np.int64)


def signed(df: DataFrame, id_col: str, text_col: str, size: int, bands: int, band_size: int, scheme: str) -> DataFrame:
    """id, digest (of the text), key (of its words in order), bands; a key's bands are there for its first row in a task."""

    def weighted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds, n = np.unique(found, return_counts=True)
        return kinds, 1 + np.log(n) if scheme == "log" else n.astype(float) if scheme == "count" else np.ones(len(n))

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            keys, out = [], []
            for _, texts in common.runs(batch, 1, 1 << 20):
                new = []
                for t in texts:
                    words = words_of(t)
                    key = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    keys.append(key)
                    if key in seen:
                        out.append(None)
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(key)
                    new.append(len(out))
                    out.append(weighted(shingles(words, size)))
                if new:
                    got = bands_of(signatures([out[k][0] for k in new], [out[k][1] for k in new], bands * band_size), bands)
                    for k, b in zip(new, got):
                        out[k] = b if len(out[k][0]) else b[:0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=["id", "digest", "key", "bands"])

    rows = df.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"), digest_of(text_col).alias("digest"))
    return rows.mapInArrow(common.returning(run), f"id {rows.schema['id'].dataType.simpleString()}, digest binary, key binary, bands array<bigint>")


def shingle_sets(df: DataFrame, text_col: str, key_col: str, size: int) -> DataFrame:
    """key, shingles (sorted, each once)."""

    def run(batches):
        for batch in batches:
            for at, texts in common.runs(batch, 1, 1 << 20):
                sets = [np.unique(shingles(words_of(t), size)).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return df.select(key_col, text_col).mapInArrow(common.returning(run), "node bigint, shingles array<bigint>")


def _beside(pairs: DataFrame, sets: DataFrame, side: str, name: str) -> DataFrame:
    """``pairs`` with the set of its column ``side`` as ``name``; a node in many pairs is split by salting."""
    busy = pairs.groupBy(side).agg(F.ceil(F.count("*") / PAIRS_TOGETHER).cast("int").alias("salts"))
    right = sets.withColumnsRenamed({"node": side, "shingles": name}).join(busy, side)
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    salted = pairs.join(busy, side).withColumn("salt", F.pmod(F.xxhash64("a", "b"), "salts").cast("int")).drop("salts")
    return salted.join(right, [side, "salt"]).drop("salt")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, further columns) whose sets are at least so similar."""
    both = _beside(_beside(pairs, sets, "b", "right"), sets, "a", "left")
    both = both.select(*pairs.columns, F.size(F.array_intersect("left", "right")).alias("n"), (F.size("left") + F.size("right")).alias("m"))
    return both.filter(F.col("n") >= F.lit(threshold) * (F.col("m") - F.col("n")) - EVEN).drop("n", "m")


def components(edges: DataFrame, width: int) -> DataFrame:
    """node, component (its smallest node) of the nodes of the edges (a, b): each takes the least label of its own, its
    neighbours and its label's node, until none changes."""
    both = common.staged(edges.select("a", "b").union(edges.select("b", "a")).distinct().coalesce(width), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    labels = common.staged(labels.select("node", F.least("node", "near").alias("component")).coalesce(width), "components")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        hop = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = labels.join(hop, "component").join(near, F.col("node") == F.col("a"))
        to = F.least("component", "further", "near")
        step = common.staged(step.select("node", to.alias("component"), (to != F.col("component")).alias("moved")).coalesce(width), "components")
        labels = step.select("node", "component")
        if not step.filter("moved").head(1):
            return labels


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 5, threshold: float = 0.8, bands: int = BANDS, band_size: int = BAND_SIZE, weights: str = "set") -> DataFrame:
    """One row per input row: the id, digest (of its text), class_id (smallest id of the class), class_size (rows),
    is_first (the row that stays when the class is thinned out to one).

    Texts of equal words (lower case, split at white space) are always in one class.  A text shorter than ``size``
    words is one shingle; texts without words are one class.  Null counts as empty.  The first row has the smallest id
    (null only where all are null); rows that repeat its id and text are marked too.  An empty table gives no rows;
    further columns are ignored.
    """
    rows = common.staged(signed(df, id_col, text_col, size, bands, band_size, weights), "signed")
    # Of a key's rows the smallest stands for it; nulls come last.
    rep = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "digest")).alias("rep")
    keyed = rows.groupBy("key").agg(rep, F.count("*").alias("n"), F.max("bands").alias("bands"))
    keyed = common.staged(keyed.select("key", "rep", "n", "bands", F.monotonically_increasing_id().alias("node")), "nodes")
    members = keyed.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = common.staged(members.join(common.staged(shared, "shared"), "bucket"), "buckets")
    nodes = common.staged(shared.select("node").distinct(), "candidates")
    labels = linked_labels(shared, nodes, _sets_of(df, id_col, text_col, keyed, nodes, size), threshold)
    named = keyed.select("key", "node", "rep", "n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = common.staged(named, "named")
    groups = common.staged(named.groupBy("component").agg(F.min("rep").alias("first"), F.sum("n").alias("class_size")), "classes")
    by_key = common.staged(named.join(groups, "component").select("key", "first", "class_size"), "by-key")
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest"))
    return rows.select("id", "digest", "key").join(by_key, "key").select(F.col("id").alias(id_col), "digest", F.col("first.id").alias("class_id"), "class_size", is_first.alias("is_first"))


def _sets_of(df: DataFrame, id_col: str, text_col: str, keyed: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, shingles of all candidates, from the texts that stand for them."""
    needed = keyed.join(nodes, "node").select("node", "rep.id", "rep.digest")
    text = df.select(F.col(id_col).alias("own_id"), digest_of(text_col).alias("own_digest"), common.text_of(text_col).alias("text"))
    found = text.join(needed, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_digest") == F.col("digest")))
    return common.staged(shingle_sets(found, "text", "node", size).dropDuplicates(["node"]), "sets")


def linked_labels(shared: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """node, component: the classes of the candidates that share buckets (bucket, node, n: its nodes), by verified links."""
    degrees = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    open_ = common.staged(shared.join(degrees, "node").select("bucket", "node", "degree"), "open")
    labels, going = nodes.select("node", F.col("node").alias("component")), True
    while going:
        placed = open_.join(labels, "node")
        leaders = placed.groupBy("bucket").agg(F.max(F.struct("degree", "node", "component")).alias("leader"), F.count("*").alias("n")).filter("n > 1")
        led = placed.join(leaders.drop("n"), "bucket").filter("node <> leader.node")
        led = common.staged(led.select("bucket", "node", "degree", "component", F.col("leader.node").alias("to"), F.col("leader.component").alias("to_component")), "led")
        pairs = led.filter("component <> to_component").select(F.col("node").alias("a"), F.col("to").alias("b"), "component", "to_component")
        pairs = common.staged(pairs.distinct(), "pairs")
        linked = common.staged(verified(pairs, sets, threshold), "linked")
        found = linked.count()
        going = found > LEAST_YIELD * pairs.count()
        if found:
            labels = merged(labels, linked)
            here, there = labels.select("node", F.col("component").alias("own")), labels.select(F.col("node").alias("to"), F.col("component").alias("led_by"))
            open_ = common.staged(led.join(here, "node").join(there, "to").filter("own <> led_by").select("bucket", "node", "degree"), "open")
    pairs = common.staged(by_prefix(apart(shared, labels), sets, threshold), "pairs")
    linked = common.staged(verified(pairs, sets, threshold), "linked")
    return merged(labels, linked) if linked.head(1) else labels


def merged(labels: DataFrame, linked: DataFrame) -> DataFrame:
    """``labels`` (node, component) after the components of linked nodes (component, to_component) have become one."""
    edges = linked.select(F.col("component").alias("a"), F.col("to_component").alias("b"))
    become = components(edges, common.width(linked.count())).select(F.col("node").alias("component"), F.col("component").alias("become"))
    return common.staged(labels.join(become, "component", "left").select("node", F.coalesce("become", "component").alias("component")), "labels")


def apart(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """node, component of the nodes in buckets of several components."""
    placed = shared.select("bucket", "node").join(labels, "node")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    return common.staged(placed.join(mixed, "bucket").select("node", "component").distinct(), "apart")


def by_prefix(nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, component, to_component) of different components that may be similar: prefix filtering, exact.

    Each set is put in the order of its shingles' frequency, rare ones first.  Sets of m and n shingles reach the
    threshold t with t / (1 + t) * (m + n) shingles in common, so their first common one, at places i and j, must have
    so many shingles behind it in either set; t / (1 + t) * (m + n) <= min(m - i, n - j).  Places at which that can't
    hold, and shingles that lie in one component only, go.  Entries meet by shingle and by the classes of both sizes,
    so that only sizes meet that the places allow; those of a shingle's commonest component don't meet each other.
    """
    share, step = threshold / (1 + threshold), float(np.log(SIZE_STEP))
    each = nodes.join(sets, "node").select("node", "component", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    counts = each.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    kinds = counts.groupBy("shingle").agg(F.sum("n").alias("often"), F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts"))
    kinds = common.staged(kinds.select("shingle", "often", F.col("top.component").alias("main"), (F.col("parts") > 1).alias("spread")), "kinds")
    entry = F.struct("often", "shingle", "main", "spread")
    ordered = each.join(kinds, "shingle").groupBy("node", "component", "size").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    able = ordered.filter(F.size(F.filter("entries", lambda e: e["spread"])) >= threshold * F.col("size") - EVEN)
    entries = able.select("node", "component", "size", F.posexplode("entries").alias("place", "e")).filter("e.spread")
    behind, size = F.col("size") - F.col("place"), F.col("size")
    # sizes of partners that a place allows
    most = F.least(behind / share - size, size / threshold) + EVEN
    class_of = lambda x: F.floor(F.log(x) / step).cast("int")
    entries = entries.withColumn("most", most).filter(F.col("most") >= threshold * size - EVEN)
    classes_ = F.sequence(class_of(F.greatest(threshold * size - EVEN, F.lit(1.0))), class_of(F.greatest("most", F.lit(1.0))))
    entries = entries.select("node", "component", "size", behind.alias("behind"), "e.shingle", (F.col("e.main") == F.col("component")).alias("is_main"), class_of(size).alias("own_class"), F.explode(classes_).alias("class"))
    entries = common.staged(entries, "entries")
    left = entries.filter(~F.col("is_main")).select("shingle", F.col("own_class").alias("left_class"), F.col("class").alias("right_class"), F.col("node").alias("a"), "component", F.col("size").alias("a_size"), F.col("behind").alias("a_behind"))
    right = entries.select("shingle", F.col("class").alias("left_class"), F.col("own_class").alias("right_class"), F.col("node").alias("b"), F.col("component").alias("to_component"), "size", "behind", "is_main")
    keys = ["shingle", "left_class", "right_class"]
    right = right.withColumnsRenamed({k: f"b_{k}" for k in keys})
    meet = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"b_{k}") for k in keys])
    enough = F.least("a_behind", "behind") >= share * (F.col("a_size") + F.col("size")) - EVEN
    pairs = left.join(right, meet & (F.col("component") != F.col("to_component")) & (F.col("is_main") | (F.col("a") < F.col("b"))) & enough)
    return pairs.select("a", "b", "component", "to_component").distinct()


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that come first in their class, all their columns; of rows that repeat id and text the one
    whose further columns are least (``common.only``)."""
    kept = classes(df, id_col, text_col, **options).filter("is_first").select(F.col(common.quoted(id_col)).alias("id"), "digest")
    return common.only(df, id_col, digest_of(common.quoted(text_col)), kept)
