"""Toxicity, quality, page extraction and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from symbolith.llm import common, html_extract, quality, toxicity


def sentence(rng, n=60):
    return " ".join("".join(rng.choice(["ta", "ri", "no", "ke", "lu", "mo"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng, docs, labels = random.Random(1), [], []
    for i in range(600):
        words = sentence(rng).split()
        toxic, junk = i % 6 == 0, i % 10 == 1
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["villain", "VILL4IN", "vіllain", "grumpface", "grumpfacery"]))
        text = " ".join(words)
        if junk:
            text = text.upper().replace(" ", "!!## ")
        docs.append((i, text, "en" if i % 3 else "de", "s", len(text)))
        labels.append((i, 0 if junk else 1, int(toxic)))
    docs += [(1000, None, "en", "s", 0), (1001, "", None, None, None), (None, sentence(rng), "xx", "s", 1), (1002, sentence(rng) * 50, "en", "s", 1), (2, docs[2][1], "de", "t", 3)]
    labels += [(None, 1, 0), (1000, None, None), (2, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_folding():
    assert toxicity.fold("V1ll@in, ｉｄіot​!\nNáïve") == " villain idiot náïve "
    assert toxicity.fold("") == "  "


def test_toxic_texts_are_found(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, rows=10_000)
    assert {t.strip() for t in model.lexicon} <= {w[:k] for w in ("villain", "grumpfacery") for k in range(3, 12)}
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic is not None}
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    assert {r.predicted for r in got if r.doc_id in (1000, 1001, None)} == {0}
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)
    remainders = docs.select("doc_id", toxicity.held_out("doc_id").alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in remainders)


def test_exceptions_and_a_missing_label(spark, corpus):
    model = toxicity.Model({" trash ": 3.0}, logistic=(-2.0, 2.0, 2.0, 2.0))
    assert model.features("the trash can") == (0.0, 0.0, 0.0) and model.features("some trash canal")[2] == 3.0
    docs, labels = corpus
    none = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).count() == docs.count()


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney by the textbook, on lists of symbols."""
    n = quality.ORDER
    counts = {n: Counter()}
    for t in texts:
        s = [0] * (n - 1) + [b + 1 for b in t.encode()] + [quality.END]
        counts[n].update(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discount(k, c):
        m = Counter(counts[k].values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] + m[2] else 0.5
        j = min(c, 3)
        return min(float(j), max(0.1, j - (j + 1) * y * m[j + 1] / m[j])) if m[j] and m[j + 1] else 0.75

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (quality.END + 1)
        same = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        total, kept = sum(same.values()), sum(discount(k, c) for c in same.values())
        c = counts[k].get(gram, 0)
        return (c - discount(k, c) if c else 0) / total + kept / total * p(gram[1:])

    return p


def test_perplexity_is_kneser_ney_by_both_paths(spark):
    rng = random.Random(2)
    texts = [sentence(rng, 8) for _ in range(6)]
    model = quality.probabilities(quality.count_grams(spark.createDataFrame([("en", t) for t in texts], "lang string, text string")))
    p = kneser_ney(texts)
    asked = [texts[0], "tari noke Zé", "", None, "qqq"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(asked)], "doc_id long, text string, lang string")
    for limit in (10**9, 0):
        got = {r.id: r.perplexity for r in quality.perplexities(df, model, broadcast_rows=limit).collect()}
        for i, t in enumerate(asked):
            s = [0] * (quality.ORDER - 1) + [b + 1 for b in (t or "").encode()] + [quality.END]
            grams = [tuple(s[k : k + quality.ORDER]) for k in range(len(s) - quality.ORDER + 1)]
            assert got[i] == pytest.approx(math.exp(-sum(math.log(p(g)) for g in grams) / len(grams)), rel=1e-4)


def test_quality_keeps_clean_rows_and_drops_junk(spark, corpus):
    docs, labels = corpus
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    assert all(r.kept == bool(truth[r.doc_id]) for r in got if r.doc_id in truth and r.doc_id is not None and r.doc_id < 600)
    assert {r.kept for r in got if r.doc_id == 1002} == {True}
    kept = quality.without_rejected(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert {r.kept for r in quality.classify(docs, labels.limit(0)).collect()} == {True}
    assert quality.classify(docs.limit(0), labels).count() == 0


ARTICLE = "<article><header class=post-header><h1>Title &amp; more</h1></header><p>First<br>block <b>bold<p>Second &eacute;&#8211;&lt;b&gt; block<div class=\"share buttons\">Share</div><ul><li>one<li>two</ul><section class=comments><p>First!</section><footer>tags</footer></article>"


def test_markup_of_an_article():
    page = f"<!doctype html><html><head><title>x</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body class=has-sidebar><nav><a href=/>Home</a></nav><!-- <p>no --><div class='cookie-notice'><div>We use</div> cookies</div><header>Site</header>{ARTICLE}<aside>Side</aside><form>Mail <input></form><footer>&copy; me</footer>"
    blocks, marked = html_extract.candidates(page)
    assert marked and blocks == ["Title & more", "First block bold", "Second é–<b> block", "one", "two"]


def test_odd_pages(spark):
    pages = [(1, "http://a.example/x", None), (2, None, ""), (None, "no host", "<p>plain <p>text"), (3, "http://a.example/y", "a < b <"), (4, "http://a.example/z", "<p>open <script>never closed"), (5, "http://a.example/w", "<!-- never closed <p>x"), (6, "http://a.example/v", '<p title="a > b">quoted</p>' * 3), (6, "http://a.example/v", '<p title="a > b">quoted</p>' * 3), (7, "http://b.example", "<div>" * 3000 + "deep" + "</b>" * 50)]
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, share long, host string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect()), key=str)
    assert got == sorted([(1, "", 0), (2, "", 0), (None, "plain\ntext", 10), (3, "a < b <", 7), (4, "open", 4), (5, "", 0), (6, "quoted\nquoted\nquoted", 20), (6, "quoted\nquoted\nquoted", 20), (7, "deep", 4)], key=str)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_shared_blocks_of_unmarked_pages_go():
    rng = random.Random(3)
    menu, legal = "Home News About Contact", "All rights reserved by the owners of this site and nobody else in the world at all times since it began"
    own = [[sentence(rng, 40), sentence(rng, 5)] for _ in range(6)]
    texts = html_extract.main_texts([([menu, *o, legal], False) for o in own])
    assert texts == ["\n".join(o) for o in own]
    marked = html_extract.main_texts([([menu, *o, legal], True) for o in own])
    assert marked == ["\n".join([menu, *o, legal]) for o in own]


def test_suffix_order_and_repeats():
    rng = np.random.default_rng(4)
    for n, kinds in ((1, 1), (2, 1), (40, 1), (300, 2), (300, 40)):
        tokens = rng.integers(0, kinds, n).astype(np.uint64)
        assert html_extract.suffix_order(tokens).tolist() == sorted(range(n), key=lambda i: tokens[i:].tolist())
    assert html_extract.suffix_order(np.zeros(0, np.uint64)).tolist() == []
    blocks = [rng.integers(2, 5, rng.integers(1, 30)).astype(np.uint64) for _ in range(24)] + [np.arange(10, 50).astype(np.uint64)] * 2
    page_of = np.arange(26) // 3
    laid = html_extract._Layout(np.concatenate(blocks), np.array(list(map(len, blocks))), 4)
    places, lengths, pages = laid.repeats(page_of)
    runs = {}
    for k, b in enumerate(blocks):
        for i in range(max(1, len(b) - 3)):
            runs.setdefault(tuple(b[i : i + 4].tolist()), []).append(page_of[k])
    own = lambda i: tuple(t for t in laid.tokens[i : i + 4].tolist() if t != 1)
    assert {own(i): n for i, n in zip(places.tolist(), pages.tolist())} == {r: len(set(p)) for r, p in runs.items() if len(p) > 1}
    assert max(lengths) >= 40  # the long substring as a whole


def host_texts(pages, classes):
    """Main texts of one host's pages by definition: every run of every block, counted over all pages."""
    n, run = len(set(classes)), html_extract.RUN
    having = {}
    spans = lambda w: [(i, min(i + run, len(w))) for i in range(max(1, len(w) - run + 1))]
    for (blocks, _), c in zip(pages, classes):
        for b in blocks:
            w = b.split()
            for i, j in spans(w):
                having.setdefault((j - i < run, *w[i:j]), set()).add(c)
    out = []
    for blocks, marked in pages:
        some, most = max(2, math.ceil(0.05 * n)), max(10, math.ceil(0.6 * n))
        under = {least: [[any(i <= k < j and len(having[j - i < run, *w[i:j]]) >= least for i, j in spans(w)) for k in range(len(w))] for w in map(str.split, blocks)] for least in (some, most)}
        first, cut = under[most if marked else some], under[most]
        if marked and sum(map(sum, first)) > 0.5 * sum(map(len, first)):
            out.append("\n".join(blocks))
            continue
        kept = [" ".join(w for w, c in zip(b.split(), cut[k]) if not c) for k, b in enumerate(blocks) if sum(first[k]) < 0.8 * len(first[k])]
        out.append("\n".join(kept or blocks))
    return out


@pytest.mark.parametrize("together", [4_000_000, 20_000, 1500])
def test_host_step_equals_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(html_extract, "TOGETHER", together)
    rng = random.Random(21)
    rows, want = [], {}
    for host, size in (("a", 60), ("b", 14), ("c", 3), ("d", 1)):
        common_ = [sentence(rng, n) for n in (3, 18, 25, 40, 70)]
        pages = []
        for k in range(size):
            blocks = [sentence(rng, rng.randint(1, 50)) for _ in range(rng.randint(1, 5))]
            for c, share in zip(common_, (1, 0.7, 0.3, 0.1, 0.03)):
                if rng.random() < share:
                    blocks.insert(rng.randrange(len(blocks) + 1), c)
            if rng.random() < 0.7:  # inside another block
                blocks[0] += " " + common_[1]
            pages.append((blocks, k % 3 == 0))
        pages += [pages[0], pages[-1]]  # copies
        classes = [repr(p) for p in pages]
        for k, ((blocks, marked), text) in enumerate(zip(pages, host_texts(pages, classes))):
            body = "".join(f"<p>{b}</p>" for b in blocks)
            rows.append((f"{host}{k}", f"http://{host}.example/{k}", f"<main>{body}</main>" if marked else body))
            want[f"{host}{k}"] = text
    got = html_extract.extract(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(5))
    got = {r.page_id: r.text for r in got.collect()}
    # pages that near_dedup takes for copies would count once; there are none but the planted ones
    assert got == want
    plain = {r[0]: "\n".join(html_extract.candidates(r[2])[0]) for r in rows}
    assert sum(plain[k] != want[k] for k in want) > 30  # only the host step does that


def test_pipeline_stages(spark, corpus, tmp_path):
    docs, labels = corpus
    copies = docs.filter("doc_id between 2 and 8").withColumn("doc_id", F.col("doc_id") + 5000)
    near = docs.filter("doc_id between 2 and 5").withColumn("doc_id", F.col("doc_id") + 6000).withColumn("text", F.concat("text", F.lit(" end")))
    docs.union(copies).union(near).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "exact_dedup", "near_dedup", "packing"]
    current, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        current = common.staged(stage(spark, current, str(tmp_path)), name)
        assert current.columns == docs.columns
        kept.append({r.doc_id for r in current.collect()})
    truth = {r.doc_id: (r.quality, r.toxic) for r in labels.collect() if r.quality is not None}
    clean = {i for i, (q, t) in truth.items() if q and not t and i is not None}
    assert clean <= kept[0] and clean <= kept[1] and not {i for i, (q, t) in truth.items() if t} & kept[1] and not {i for i, (q, _) in truth.items() if not q} & kept[0]
    assert kept[2] == {i for i in kept[1] if i is None or not 5000 <= i < 6000} - {1001}
    assert clean <= kept[3] and not {i for i in kept[3] if i and i >= 5000}
    packed = corpus_pipeline.STAGES[4][1](spark, current, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == kept[3]


def test_copies_of_a_page_are_one_page(spark):
    rng = random.Random(11)
    base, other = [sentence(rng, 40) for _ in range(8)], [[sentence(rng, 40) for _ in range(8)] for _ in range(4)]
    near = [base[:k % 8] + [base[k % 8] + f" changed {k}"] + base[k % 8 + 1 :] for k in range(12)]
    exact = [base] * 12
    for pages in (exact, near):
        for marked in (True, False):
            host = f"{'m' if marked else 'u'}.example"
            body = lambda p: "".join(f"<p>{b}</p>" for b in p)
            rows = [(k, f"http://{host}/{k}", f"<article>{body(p)}</article>" if marked else body(p)) for k, p in enumerate(pages + other)]
            got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
            assert got == {k: "\n".join(p) for k, p in enumerate(pages + other)}


def test_runs_are_counted_over_the_whole_host(spark, monkeypatch):
    rng = random.Random(12)
    notices = [sentence(rng, n) for n in (5, 20, 40)]
    rows = []
    for k in range(40):
        own = [sentence(rng, n) for n in (3, 30, 60, 15)]
        shared = [notices[0], notices[1]] + [notices[2]] * (k % 20 == 0)  # the last on two pages only
        body = "".join(f"<p>{b}</p>" for b in shared + own)
        rows.append((k, f"http://{'big' if k < 39 else 'small'}.example/{k}", f"<main>{body}</main>" if k % 4 == 0 else body))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert not any(n in whole[k] for n in notices[:2] for k in range(39)) and all(n in whole[39] for n in notices[:2])
    assert [k for k in range(39) if notices[2] in whole[k]] == [0, 20]  # marked, and not most of the host
    monkeypatch.setattr(html_extract, "TOGETHER", 600)
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == whole


def test_all_parts_of_a_marked_article_stay():
    long = "long " * 200
    cases = [
        (f"<main><h1>Title</h1><p>lead</p><article><p>{long}</p></article><p>end</p></main>", ["Title", "lead", long.strip(), "end"]),
        (f"<article><h1>Title</h1><div itemprop=articleBody><p>{long}</p></div></article>", ["Title", long.strip()]),
        (f"<article><p>{long}</p></article><p>between</p><article><p>short</p></article>", [long.strip(), "short"]),
        (f"<article><p>{long}</p><article class=comment><p>no</p></article><article class='ad'><p>no</p></article><article class=related-post><p>no</p></article></article>", [long.strip()]),
    ]
    for page, blocks in cases:
        assert html_extract.candidates(page) == (blocks, True)


def test_the_same_rows_are_kept_however_the_model_travels(spark, corpus, monkeypatch):
    docs, labels = corpus
    sent = {(r.doc_id, r.model, r.kept, r.threshold) for r in quality.classify(docs, labels).collect()}
    monkeypatch.setattr(quality, "SENT_IDS", 0)
    joined = quality.classify(docs, labels, broadcast_rows=0).collect()
    assert {(r.doc_id, r.model, r.kept) for r in joined} == {x[:3] for x in sent}
    limits = {m: t for _, m, _, t in sent}
    assert all(r.threshold == pytest.approx(limits[r.model], rel=1e-9) for r in joined)


def test_thresholds_are_quantiles_of_the_language(spark):
    """Own quantile with enough calibration rows, else the pooled quantile of the ratios to the median."""
    rng = random.Random(17)
    docs = [(i, sentence(rng, rng.randint(20, 80)), "en" if i < 900 else "de") for i in range(1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in docs], "doc_id long, quality int")
    got = quality.classify(df, labels, quantile=0.98).collect()
    apart = {r.id for r in spark.range(1000).filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(quality.CALIBRATE)) == 0).collect()}
    size = {i: len(t.encode()) + 1 for i, t, _ in docs}
    fair = {r.doc_id: r.perplexity * math.exp(-quality.SHORT / math.sqrt(size[r.doc_id])) for r in got}
    rank = lambda values, q: sorted(values)[math.ceil(q * len(values)) - 1]
    by = {m: [fair[r.doc_id] for r in got if r.model == m and r.doc_id in apart] for m in ("en", "de")}
    assert len(by["en"]) >= 50 > len(by["de"]) > 0
    medians = {m: rank(v, 0.5) for m, v in by.items()}
    pooled = rank([x / medians[m] for m, v in by.items() for x in v], 0.98)
    want = {"en": rank(by["en"], 0.98), "de": medians["de"] * pooled}
    assert {r.model: r.threshold for r in got} == pytest.approx(want, rel=1e-6)
    assert all(r.kept == (fair[r.doc_id] <= r.threshold * (1 + 1e-12)) for r in got)


def test_the_model_grows_with_trusted_text(spark):
    rng = random.Random(13)
    texts = [("en", "".join(rng.choice("abcdefgh") for _ in range(2000))) for _ in range(20)]
    size = lambda rows: quality.count_grams(spark.createDataFrame(rows, "lang string, text string")).filter("lang = 'en'").count()
    assert size(texts) > 1.3 * size(texts[:10])


def test_an_odd_trusted_text_does_not_set_the_threshold(spark):
    rng = random.Random(14)
    odd = lambda: " ".join("".join(rng.choice("bcdfghjpqvwxyz") for _ in range(6)) for _ in range(60))
    apart = {r.id for r in spark.range(1500).filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(quality.CALIBRATE)) == 0).collect()}
    docs = [(i, sentence(rng), "en") for i in range(1500)]
    for i in sorted(apart)[:2]:
        docs[i] = (i, odd(), "en")
    labels = spark.createDataFrame([(i, 1) for i, *_ in docs], "doc_id long, quality int")
    df = spark.createDataFrame(docs + [(2000 + k, odd(), "en") for k in range(20)], "doc_id long, text string, lang string")
    got = quality.classify(df, labels).collect()
    assert not any(r.kept for r in got if r.doc_id >= 2000)
    assert sum(not r.kept for r in got if r.doc_id < 1500) <= 0.02 * 1500
