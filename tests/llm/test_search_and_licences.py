"""Top-k search and licence scans against brute force."""

import math
import random
import re

import numpy as np
import pytest

from symbolith.llm import licences, top_k

SCHEMA = "vec_id long, embedding array<float>, id string, v int"


def brute(rows, k, every):
    use = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in use:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in use if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(top_k, "BUCKET", 37)
    monkeypatch.setattr(top_k, "QUERIES", 5)
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=16) * rng.exponential(0.3)).tolist(), "x", 1) for i in range(400)]
    rows += [(400 + i, [0.25] * 16, "x", 1) for i in range(60)]  # ties
    rows += [(500, None, "x", 1), (510, [None] * 16, "x", 1), (520, [float("nan")] * 16, "x", 1), (530, [float("inf")] * 16, "x", 1), (None, [1.0] * 16, "x", 1), (540, [], "x", 1), (550, [1.0, 2.0], "x", 1), (551, [1.0, 3.0], "x", 1), (560, [0.0] * 16, "x", 1), (601, [0.25] * 16, "x", 1), (601, [0.25] * 16, "x", 1)]
    got = top_k.top_k(spark.createDataFrame(rows, SCHEMA), k=10, every=10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 10)


def test_every_way_of_pruning_keeps_the_best():
    rng = np.random.default_rng(3)
    least = np.iinfo(np.int64).min
    for _ in range(60):
        c = np.floor(rng.normal(size=(80, 6)) * 300).astype(np.int64)
        c[:3] = c[0]
        q = np.vstack([c[:4], np.floor(rng.normal(size=(3, 6)) * 300).astype(np.int64)])
        ids, q_ids = np.arange(80), np.arange(1000, 1007)
        longest = float(np.sqrt((c**2).sum(1).max()))
        scores = q @ c.T
        for bound in (np.full(7, least), np.sort(scores, 1)[:, -5], np.sort(scores, 1)[:, -40], scores.max(1) + 1):
            got = {}
            for row, i, s in top_k.search_bucket(q_ids, q, bound.astype(np.int64), ids, c, longest, 5):
                got.setdefault(row, []).append((-s, i))
            for row in range(7):
                want = sorted((-s, i) for i, s in enumerate(scores[row].tolist()) if s >= bound[row])[:5]
                assert sorted(got.get(row, [])) == want


def _joins(plan):
    """Names of the columns on either side of each join of a plan."""
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    if plan.nodeName() == "Join":
        yield [{c.output().apply(i).name() for i in range(c.output().size())} for c in children]
    for c in children:
        yield from _joins(c)


def test_no_join_pairs_the_vectors_of_blocks_and_buckets(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist(), "x", 1) for i in range(300)], SCHEMA)
    for left, right in _joins(top_k.top_k(df)._jdf.queryExecution().optimizedPlan()):
        assert not any("data" in c for c in left) or not any("data" in c for c in right), (left, right)


@pytest.mark.parametrize("list_worth", [0, 1 << 40])
def test_top_k_over_many_cells(spark, monkeypatch, list_worth):
    for name, value in (("BUCKET", 29), ("QUERIES", 7), ("CELL_QUERIES", 3000), ("CELL_BUCKETS", 2000), ("FIRST", 0.1), ("LIST_WORTH", list_worth)):
        monkeypatch.setattr(top_k, name, value)
    rng = np.random.default_rng(8)
    some = rng.normal(size=(150, 12)) * rng.exponential(0.4, size=(150, 1))
    rows = [(i, some[i % 150].tolist(), "x", 1) for i in range(450)]  # copies
    rows += [(i, (some[i % 150] * 1.01 + 0.001).tolist(), "x", 1) for i in range(450, 600)]
    rows += [(i, [0.3] * 12, "x", 1) for i in range(600, 750)]  # a common vector
    rows += [(i, (rng.normal(size=12) * 100).tolist(), "x", 1) for i in range(750, 800)]  # 32-bit numbers
    rows += [(i, (rng.normal(size=3) * 1e5).tolist(), "x", 1) for i in range(800, 840)]  # 64-bit products
    rows += [(840, [2.5e6, 1.0, -1.0], "x", 1)]  # a 64-bit number
    got = top_k.top_k(spark.createDataFrame(rows, SCHEMA), k=10, every=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 5)


def test_what_is_kept_of_a_query_does_not_grow_with_the_buckets():
    rng = np.random.default_rng(5)
    c = rng.integers(-300, 300, size=(900, 6))
    c[300:600] = c[0]
    ids = rng.permutation(900).astype(np.int64)
    block = top_k.Block(0, ids[:40], c[:40], np.full(40, top_k.LEAST), 4)
    for i in range(0, 900, 50):
        block.meet(top_k.Bucket(ids[i : i + 50], c[i : i + 50], float(np.sqrt((c[i : i + 50] ** 2).sum(1).max()))))
    got = sorted(zip(*(block.results().column(n).to_pylist() for n in ("row", "score", "id"))))
    want = [(r, s, i) for r in range(40) for s, i in sorted(((int(c[r] @ v), int(i)) for v, i in zip(c, ids) if i != ids[r]), key=lambda x: (-x[0], x[1]))[:4]]
    assert got == sorted(want) and len(got) == 160


def test_large_components_stay_exact():
    q = np.array([[2**30 + 1, 3]], np.int64)
    assert top_k._products(q, q)[0, 0] == (2**30 + 1) ** 2 + 9


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_of(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    firsts = [i for i, _ in places]
    return len(words), len(places), min(firsts, default=None), max(firsts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_columns_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = "under the MIT license Apache LICENSE, version 2 2.0 cc by-nc BY NC x licença É \n under-the mit".split(" ")
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += [None, "", "under the mit license under the mit license", "cc by nc by nc", "CC BY-NC 4.0", "under the mit licenseé", "İ under THE mit license", "a" * 50000, "under the mit license " * 2000]
    df = spark.createDataFrame([(i, t, "x", 2) for i, t in enumerate(texts)], "doc_id long, text string, id string, score int")
    for r in licences.scan(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(texts[r.doc_id]), texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1 and (r.score == 1 if r.n_base else True)


def test_notices_are_found_by_their_spans(spark):
    gpl = "Intro. This work is licensed under the GNU General Public License, version 3. Outro"
    bsd = "/* Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the conditions below are met */"
    far = "redistribution and use in source " + "word " * 50 + "and binary forms with or without"
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame([(1, gpl), (2, bsd), (3, far), (4, "the license of the software is free of charge")], "doc_id long, text string")).collect()}
    assert got[1].labels == "gpl-3" and got[1].base_labels == "" and (got[1].spans[0].first_word, got[1].spans[0].last_word) == (4, 12)
    assert got[2].labels == "bsd" and got[2].score < 1
    assert got[3].labels == "" and got[4].labels == "" and got[4].spans == []


def test_matching_statistics_equal_brute_force():
    rng = random.Random(6)
    sequences = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))] for _ in range(6)]
    machine = licences.Automaton(sequences)
    joined = [b" " + b" ".join(s) + b" " for s in sequences]
    for _ in range(200):
        text = [rng.choice([b"a", b"b", b"c"]) for _ in range(15)]
        ids = [machine.word[w] if w in machine.word else -1 for w in text]
        for i, (state, n) in enumerate(machine.stream(ids)):
            fits = [m for m in range(i + 2) if any(b" " + b"".join(w + b" " for w in text[i + 1 - m : i + 1]) in j for j in joined)]
            assert n == max(fits)
            piece = b" " + b"".join(w + b" " for w in text[i + 1 - n : i + 1])
            if n:
                want = sorted((k, e) for k, q in enumerate(sequences) for e in range(n, len(q) + 1) if q[e - n : e] == text[i + 1 - n : i + 1])
                assert sorted(machine.occurrences(state)) == want, piece
                suffix = {}
                for k, q in enumerate(sequences):
                    for e in range(1, len(q) + 1):
                        m = next((m for m in range(min(n, e) + 1) if m == min(n, e) or q[e - m - 1] != text[i - m]))
                        if m >= 2:
                            suffix[k, e] = m
                assert {(k, e): min(m, n) for k, e, m in machine.suffixes(state, 2)} == suffix


def spans_of(words, label, template):
    """Spans of one template: all maximal common runs on all diagonals, chained with every run before."""
    runs = []
    for i in range(len(words)):
        for j in range(len(template)):
            n = 0
            while i + n < len(words) and j + n < len(template) and words[i + n] == template[j + n]:
                n += 1
            if n >= licences.LEAST and not (i and j and words[i - 1] == template[j - 1]):
                runs.append((i, i + n, j, j + n))
    runs.sort(key=lambda r: (r[1], r[3]))
    chains = []
    for a, b, c, d in runs:
        options = [(b - a, a)]
        for (_, e, _, f), (best, first, _) in zip(runs, chains):
            cut = max(0, e - a, f - c)
            if e < b and f < d and a + cut - e <= licences.GAP and cut < b - a:
                options.append((best + b - a - cut, first))
        chains.append((*max(options), b))
    out = []
    for covered, first, end in sorted(chains, key=lambda c: (-c[0], c[2] - c[1], c[1])):
        if covered >= licences.COVERED * len(template) and all(end <= s or first > e for _, s, e, *_ in out):
            out.append((label, first, end - 1, covered / len(template), covered))
    return out


def test_spans_equal_a_quadratic_chain():
    rng = random.Random(9)
    templates = [("x", "a b c d e f g h i j k l"), ("y", "c d e f x y z a b c d e"), ("x", "a b c d"), ("z", "a a a a b a a a a b a a")]
    machine = licences.Scanner(templates, [("a b c", "p")])
    clauses = [t.split() for _, t in templates]
    found = 0
    for _ in range(1500):
        words = []
        for _ in range(rng.randint(1, 6)):  # clauses that are repeated, reordered, cut and gapped
            c = rng.choice(clauses)
            i = rng.randrange(len(c))
            words += c[i if rng.random() < 0.5 else 0 : rng.randint(i + 1, len(c))] + [rng.choice("abcxq") for _ in range(rng.choice([0, 0, 0, 1, 3, 6]))]
        got = machine.scan([w.encode() for w in words])[1]
        want = licences.resolved([s for (label, t) in templates for s in spans_of(words, label, t.split())])
        assert got == want
        assert all(a[0] == b[0] or a[2] < b[1] or b[2] < a[1] for a in got for b in got)
        found += len(want)
    assert found > 300


def test_clauses_that_are_repeated_or_reordered_give_no_label():
    machine = licences.scanner(tuple(licences.TEMPLATES), tuple(licences.PHRASES.items()))
    spans = lambda text: machine.scan(licences.words_of(text))[1]
    assert spans("licensed under the apache licensed under the apache") == []
    half = "unless required by applicable law or agreed to in writing software"
    assert spans(" ".join([half] * 3)) == []
    notice = next(t for k, t in licences.TEMPLATES if k == "bsd").split()
    assert spans(" ".join(notice[14:] + notice[:14])) == []
    twice = spans(" ".join(notice + ["and", "more"] + notice))
    assert [(label, a, b, c) for label, a, b, c, _ in twice] == [("bsd", 0, len(notice) - 1, 1.0), ("bsd", len(notice) + 2, 2 * len(notice) + 1, 1.0)]


def test_similar_notices_give_their_own_label():
    machine = licences.scanner(tuple(licences.TEMPLATES), tuple(licences.PHRASES.items()))
    for label, text in licences.TEMPLATES:
        found = {s[0] for s in machine.scan(licences.words_of(f"some words {text} more"))[1]}
        assert found == {label}, text


def test_empty_tables(spark):
    assert top_k.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
