"""Exact and near deduplication against brute force, with planted groups and odd rows."""

import hashlib
import random
import re
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Row

from symbolith.llm import common, exact_dedup, near_dedup

SCHEMA = "doc_id long, text string, name string, h long, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], SCHEMA)


def expected_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, kept = (min(known) if known else None), False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not kept, hashlib.sha256(text.encode()).hexdigest()))
            kept |= i == keep
    return sorted(out, key=str)


def odd_rows():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))) for i in range(120)]
    long = "".join(rng.choice("xyz ") for _ in range(3000))
    rows += [(200, long), (201, long.replace(" ", "\n\t")), (202, long + "!"), (203, long[:-1]), (204, long[:1024]), (205, long[:1025])]
    rows += [(300, None), (301, ""), (302, " "), (303, "\n"), (304, " "), (None, "a b"), (None, "a  b"), (None, "only null"), (5, "twice"), (5, "twice"), (5, "other text"), (310, "é中😀" * 400), (311, "é中😀" * 400)]
    return rows


@pytest.mark.parametrize("hot_rows, share", [(1000, 1 / 2000), (2, 1 / 50)])
def test_exact_dedup(spark, monkeypatch, hot_rows, share):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rows = odd_rows() + [(1000 + i, "the hot copy " * 90) for i in range(60)]
    got = exact_dedup.exact_dedup(frame(spark, rows), block=64).collect()
    assert sorted(map(tuple, got), key=str) == expected_exact(rows)
    kept = exact_dedup.without_copies(frame(spark, rows), block=64)
    assert kept.columns == ["doc_id", "text", "name", "h", "digest"]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert sorted((r.doc_id, norm(r.text)) for r in kept.collect() if r.doc_id is not None) == sorted({(g[1], norm(t)) for g in expected_exact(rows) for i, t in rows if g[3] and i == g[0] and i is not None and hashlib.sha256(norm(t).encode()).hexdigest() == g[4]})


def test_exact_dedup_plan_is_native(spark):
    plan = exact_dedup.exact_dedup(frame(spark, odd_rows()), block=64)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def jaccard(a, b, size=5):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def near_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(6))
    rows = []
    for group in range(6):
        base = [word() for _ in range(150)]
        rows.append(" ".join(base))
        for copy in range(12):
            w = list(base)
            for _ in range(rng.randint(1, 9)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    passage = [word() for _ in range(60)]
    rows += [" ".join([word() for _ in range(90)] + passage + [word() for _ in range(90)]) for _ in range(30)]
    rows += [" ".join([word() for _ in range(20)] * 6) for _ in range(3)]
    rows = list(enumerate(rows))
    rows += [(500, rows[0][1].upper()), (501, rows[0][1] + " "), (502, None), (503, ""), (504, " \n"), (505, "one two"), (506, "one  TWO"), (507, "one three"), (None, rows[3][1]), (None, "nobody else has this"), (8, "an id of two texts"), (9, rows[9][1])]
    return rows


def test_near_dedup_equals_brute_force(spark):
    rows = near_rows()
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    words = [tuple((t or "").lower().split()) for _, t in rows]
    for a, b in combinations(range(len(rows)), 2):
        if words[a] == words[b] or words[a] and words[b] and jaccard(rows[a][1], rows[b][1]) >= 0.8:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    want = []
    for k, (i, _) in enumerate(rows):
        ids = groups[find(k)]
        want.append((i, min((x for x in ids if x is not None), default=None), len(ids)))
    got = near_dedup.classes(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=str) == sorted(want, key=str)
    kept = near_dedup.without_near_copies(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "name", "h", "digest"]
    assert kept.count() == len(groups)


def test_register_agreement_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    names = rng.integers(1, 2**63, 60).astype(np.uint64)
    a, b = names[:50], names[10:]
    wa, wb = rng.random(50) + 0.1, rng.random(50) + 0.1
    va, vb = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    shared = set(va) & set(vb)
    exact = sum(1 / sum(max(va.get(e, 0) / va[d], vb.get(e, 0) / vb[d]) for e in set(va) | set(vb)) for d in shared)
    s = near_dedup.signatures([a, b], [wa, wb], 4000)
    assert abs((s[0] == s[1]).mean() - exact) < 0.04


def test_stragglers_are_compared_in_full(spark, monkeypatch):
    rows = near_rows()[:40]
    want = {r.doc_id: r.class_id for r in near_dedup.classes(frame(spark, rows)).collect()}
    # no leaders at all: whatever shares a bucket goes to the prefix filter
    monkeypatch.setattr(near_dedup, "LEAST_YIELD", 1.0)
    shut = lambda shared, nodes, sets, t: near_dedup.merged(nodes.select("node", near_dedup.F.col("node").alias("component")), near_dedup.verified(near_dedup.by_prefix(near_dedup.apart(shared, nodes.select("node", near_dedup.F.col("node").alias("component"))), sets, t), sets, t))
    monkeypatch.setattr(near_dedup, "linked_labels", shut)
    assert want == {r.doc_id: r.class_id for r in near_dedup.classes(frame(spark, rows)).collect()}


def diverging(n=160, size=120, seed=4):
    """Sets around one centre, each with changes of its own, some of them shared."""
    rng = random.Random(seed)
    centre = rng.sample(range(10**6), size)
    pool = [rng.sample(range(10**6, 2 * 10**6), 5) for _ in range(30)]
    sets = []
    for _ in range(n):
        own = set(centre)
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(size - 5)
            own -= set(centre[at : at + 4])
            own |= set(rng.choice(pool) if rng.random() < 0.4 else rng.sample(range(2 * 10**6, 3 * 10**6), 4))
        if rng.random() < 0.2:
            own = set(list(own)[: rng.randint(60, 120)])
        sets.append(sorted(own))
    return sets


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_prefix_filter_loses_no_link(spark, threshold):
    sets = diverging()
    similar = lambda a, b: len(set(sets[a]) & set(sets[b])) >= threshold * len(set(sets[a]) | set(sets[b])) - 1e-9
    # components: a third of the sets in one, the others alone
    component = [0 if k % 3 == 0 else k for k in range(len(sets))]
    want = {(a, b) for a, b in combinations(range(len(sets)), 2) if component[a] != component[b] and similar(a, b)}
    nodes = spark.createDataFrame([*enumerate(component)], "node long, component long")
    table = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "node long, shingles array<bigint>")
    got = near_dedup.by_prefix(nodes, table, threshold)
    pairs = {(min(r.a, r.b), max(r.a, r.b)) for r in got.collect()}
    assert want and want <= pairs
    if threshold == 0.8:
        assert len(pairs) < 0.4 * len(sets) ** 2 / 2  # most of those that can't be similar don't meet
    linked = near_dedup.verified(got, table, threshold).collect()
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in linked} == want
    assert all(r.component == component[r.a] and r.to_component == component[r.b] for r in linked)


def test_near_dedup_finds_the_pairs_of_the_table(spark):
    """Whole documents of sf0.01 against all pairs by an inverted index: at least 0.9 of the pairs in one class, none
    of different components together."""
    path = Path("/root/testdata/sf0.01")
    if not path.exists():
        pytest.skip("no tables")
    docs = common.table(spark, str(path), "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := t.lower().split())}
    places = {}
    for i, s in sets.items():
        for x in s:
            places.setdefault(x, []).append(i)
    shared = {}
    for ids in places.values():
        for pair in combinations(ids, 2):
            shared[pair] = shared.get(pair, 0) + 1
    links = [p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n) - 1e-9]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert len(links) > 50 and sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    blank = [i for i in texts if i not in sets]
    for a, b in [*links, *zip(blank, blank[1:])]:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all(find(i) == find(c) for i, c in got.items())


@pytest.mark.parametrize("thin", [exact_dedup.without_copies, near_dedup.without_near_copies])
def test_any_further_columns_come_through(spark, thin):
    schema = "doc_id long, text string, m map<string,int>, `a.b` array<int>, `__digest` binary, id string, row int, digest int, own_id int"
    row = lambda i, t, n: (i, t, {"k": n}, [n], b"own", "x", n, n, None)
    df = spark.createDataFrame([row(1, "some words of a text here", 7), row(1, "some words of a text here", 5), row(2, "some words of a text here", 1), row(3, "others", 2), row(4, None, 3), row(None, "", 4)], schema)
    out = thin(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r["a.b"], r.m, r.row, bytes(r["__digest"])) for r in out.collect()), key=str) == [(1, [5], {"k": 5}, 5, b"own"), (3, [2], {"k": 2}, 2, b"own"), (4, [3], {"k": 3}, 3, b"own")]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "local-cluster[3,2,1024]", "x"

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_empty_tables(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    assert near_dedup.classes(frame(spark, [])).count() == 0
    assert exact_dedup.exact_dedup(frame(spark, [(None, None)])).collect() == [Row(doc_id=None, keep_id=None, group_size=1, kept=True, text_sha256=hashlib.sha256(b"").hexdigest())]


def test_near_copies_that_repeat_lines_differently(spark):
    rng, rows = random.Random(8), []
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(6))
    for pair in range(60):
        line, rest = [word() for _ in range(100)], [word() for _ in range(100)]
        other = list(rest)
        for k in (20, 45, 70):
            other[k] = word()
        rows += [(2 * pair, " ".join(line + rest)), (2 * pair + 1, " ".join(line * 100 + other))]
        assert jaccard(rows[-1][1], rows[-2][1]) >= 0.8
    got = {r.doc_id: r.class_id for r in near_dedup.classes(frame(spark, rows)).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}
