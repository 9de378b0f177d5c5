"""Main text of web pages by markup and by the host's suffix array.

Markup: a page is read once into blocks; what lies in menus, headers, footers, sidebars, forms, notices, adverts,
comments, scripts and the like is left out, by element and by words of class, id and role.  If the page marks its
article (article, main, articleBody), the blocks are all those inside the outermost such elements.

Host suffix array: the blocks of a host's distinct pages are concatenated as word streams, and their suffixes sorted by
prefix doubling.  Neighbours in that order that agree in ``RUN`` words or more form intervals; an interval is a substring
repeated on so many distinct pages, as long as its least common prefix.  What such substrings cover is boilerplate:
covered blocks are removed, covered words inside other blocks are cut out, and unique runs stay.

How many pages make a substring boilerplate depends on the pages of the whole host (``SHARE``, ``MARKED_SHARE``):
articles quote and copy each other, so inside a marked article only what most of a host's pages share counts.  Pages
of equal content count once, and so do near copies (classes of ``near_dedup``) among pages that don't mark an article;
a marked article that is mostly covered is a copy of others and stays whole, as does a page that nothing is left of.

A host is looked at in windows of about ``TOGETHER`` characters, dealt by content.  A substring on a share of the
host's pages is on that share of the pages of some window at least, so each window's suffix array names candidates and
none is missed; their pages are then counted over all windows of the host, and the counts decide.  Results depend
neither on windows nor on the size of a host, and a task holds one window.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, near_dedup

#: Words of a substring that counts when repeated, characters of a host that a task looks at together.
RUN, TOGETHER = 16, 4_000_000
#: Large hosts, or near copies, whose table goes to all tasks at most; a larger one is joined by a shuffle.
SENT_ROWS = 100_000
#: Similarity of the candidate blocks from which two pages are near copies, and words of a shingle.
NEAR, SHINGLE = 0.8, 5
#: Distinct pages that make a substring boilerplate: share of the host's and least number; inside marked articles.
SHARE, PAGES = 0.05, 2
MARKED_SHARE, MARKED_PAGES = 0.6, 10
#: Share of a marked article's words from which what is covered is the article.
MOSTLY = 0.5
#: Share of a block's words that is covered when the block is removed; of its characters in links, outside articles.
COVERED, LINKED = 0.8, 0.6
#: Elements by their part in a page (fixed values of the markup language).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object canvas audio video xmp".split())
LEFT_OUT = frozenset("nav footer aside form head menu dialog button select datalist".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CLOSED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Words of class, id or role that mark what isn't the article; the weaker ones not beside a word of the article.
STRONG = frozenset("ad ads advert advertisement adverts sponsor sponsored promo promoted promotion comment comments disqus respond replies cookie cookies consent gdpr newsletter subscribe signup share sharing social related recommended breadcrumb breadcrumbs popup modal login complementary contentinfo navigation".split())
WEAK = frozenset("header footer menu nav navbar sidebar banner notice notices alert widget toolbar search pagination".split())
#: ... that an article element of its own is left out for.
ASIDE = frozenset("ad ads advert advertisement adverts sponsor sponsored promo promoted promotion comment comments related recommended".split())
ARTICLE = frozenset("article content main post entry story body text".split())
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _tag_end(page: str, at: int) -> int:
    """Place of the > that ends the tag, quoted ones skipped; the end of the page if none does."""
    quote = end = at
    end = page.find(">", at)
    if end < 0:
        return len(page)
    quote = page.find('"', at, end)
    single = page.find("'", at, end)
    if quote < 0 and single < 0:
        return end
    i = at
    while i < len(page):
        c = page[i]
        if c == ">":
            return i
        if c in "\"'" and page[i - 1 : i] == "=":
            close = page.find(c, i + 1)
            if close < 0:
                return end
            i = close
        i += 1
    return end


def _unwanted(name: str, attributes: str, inside: bool) -> bool:
    if name in LEFT_OUT:
        return True
    if name == "header":
        return not inside
    if name in ("html", "body", "main") or not attributes:
        return False
    found: set[str] = set()
    for key, value in _ATTRIBUTE.findall(attributes):
        found.update(w.lower() for w in _WORD.findall(value))
        if key.lower() == "role" and value.strip("\"'").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"):
            return True
    if name == "article":
        return bool(found & ASIDE)
    return bool(found & STRONG) or bool(found & WEAK) and not found & ARTICLE and not (inside and found & {"header"})


def blocks_of(page: str) -> tuple[list[tuple[str, bool, float]], bool]:
    """Blocks as (text, whether it is in a marked article, share of characters in links); whether any is marked."""
    blocks: list[tuple[str, bool, float]] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]  # name, left out, in an article
    parts: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = sum(len(t) for t, in_link in parts if in_link)
                blocks.append((text, stack[-1][2], linked / max(1, sum(len(t) for t, _ in parts))))
            parts.clear()

    def pop(name: str, among: int) -> None:
        nonlocal links
        for gone, _, _ in stack[among:]:
            links -= gone == "a"
        del stack[among:]

    at = 0
    while at < len(page):
        mark = page.find("<", at)
        text = page[at:] if mark < 0 else page[at:mark]
        if text and not stack[-1][1]:
            parts.append((entities.unescape(text) if "&" in text else text, links > 0))
        if mark < 0:
            break
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = len(page) if end < 0 else end + 3
            continue
        got = _NAME.match(page, mark + 1)
        if got is None:
            if page[mark + 1 : mark + 2] in ("!", "?", "/"):
                at = _tag_end(page, mark + 1) + 1
            else:  # a sign of the text
                if not stack[-1][1]:
                    parts.append(("<", links > 0))
                at = mark + 1
            continue
        name = got[1].lower()
        end = _tag_end(page, got.end())
        at = end + 1
        if page[mark + 1] == "/":
            if name in BLOCKS:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if stack[k][2] != stack[k - 1][2]:
                        flush()
                    pop(name, k)
                    break
            continue
        if name in RAW:
            if page[end - 1 : end] == "/" and name in ("svg", "math"):
                continue
            close = re.compile(f"</{name}[\\s/>]", re.I).search(page, at)
            at = len(page) if close is None else _tag_end(page, close.start() + 2) + 1
            parts.append((" ", False))
            continue
        if name in BLOCKS:
            flush()
        if name in VOID:
            parts.append((" ", False))
            continue
        for k in range(len(stack) - 1, 0, -1):
            open_ = stack[k][0]
            if name in CLOSED_BY.get(open_, ()):
                flush()
                pop(open_, k)
                break
            if open_ in BLOCKS and open_ != "p":
                break
        if name in ("td", "th"):
            parts.append((" ", False))
        _, out, article = stack[-1]
        attributes = page[got.end() : end]
        if not out:
            out = _unwanted(name, attributes, article)
        if not (out or article) and (name in ("article", "main") or "articleBody" in attributes):
            flush()
            article = True
        if out and not stack[-1][1]:
            flush()
        links += name == "a"
        stack.append((name, out, article))
    flush()
    return blocks, any(b[1] for b in blocks)


def candidates(page: str | None) -> tuple[list[str], bool]:
    """Texts of the blocks that may be the article's, and whether the page marks it."""
    blocks, marked = blocks_of(page or "")
    if not marked:
        return [t for t, _, linked in blocks if linked < LINKED], False
    return [t for t, article, _ in blocks if article], True


def suffix_order(tokens: np.ndarray) -> np.ndarray:
    """Begins of all suffixes in order: prefix doubling, going on only with suffixes that are still tied."""
    n = len(tokens)
    kinds, back, often = np.unique(tokens, return_inverse=True, return_counts=True)
    rank = np.append((np.cumsum(often) - often)[back], -1)  # of a group of ties: the place of its first
    tied, step = np.flatnonzero(often[back] > 1), 1
    while len(tied):
        further = rank[np.minimum(tied + step, n)]
        order = np.lexsort((further, rank[tied]))
        tied, group, further = tied[order], rank[tied][order], further[order]
        place = np.arange(len(tied))
        head = np.append(True, group[1:] != group[:-1])
        new = head | np.append(True, further[1:] != further[:-1])
        first = np.maximum.accumulate(np.where(head, place, 0))
        own = np.maximum.accumulate(np.where(new, place, 0))
        rank[tied] = group + own - first
        alone = new & np.append(new[1:], True)
        tied, step = tied[~alone], 2 * step
    order = np.empty(n, np.int64)
    order[rank[:n]] = np.arange(n)
    return order


#: Odd factor of the polynomial hashes, and its inverse modulo 2 ** 64.
FACTOR = 0xD1342543DE82EF95
INVERSE = pow(FACTOR, -1, 1 << 64)


@lru_cache(1)
def _signs() -> np.ndarray:
    return near_dedup._mixed(np.arange(1, 257, dtype=np.uint64) * near_dedup.GOLDEN)


class _Powers:
    """Powers of an odd number modulo 2 ** 64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.held = np.uint64(base), np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.held):
            self.held = np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(2 * n - 1, self.base)))
        return self.held[:n]


POWERS, INVERSES = _Powers(FACTOR), _Powers(INVERSE)


def word_hashes(blocks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all blocks (words between single spaces), and how many words each block has."""
    data = np.frombuffer("\n".join([*blocks, ""]).encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero((data == 0x20) | (data == 0x0A))
    begins = np.append(0, ends[:-1] + 1)[: len(ends)]
    lengths = ends - begins
    place = np.arange(len(data)) - np.repeat(begins, lengths + 1)
    values = _signs()[data]
    values *= POWERS(int(lengths.max(initial=0)) + 1)[place]
    total = np.add.reduceat(values, begins) if len(begins) else np.zeros(0, np.uint64)
    counts = np.diff(np.flatnonzero(data[ends] == 0x0A), prepend=-1)
    return near_dedup._mixed(total + lengths.astype(np.uint64)), counts


class _Layout:
    """Blocks of words in a row, and the places where a run begins.

    A run stays inside a block, or is the whole of a shorter one; hashes of words and marks of block ends are the tokens.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, run: int):
        # an end mark of its own kind fills the block up to the length of a run, so that short blocks compare whole
        total = lengths + np.maximum(1, run - lengths)
        self.run, self.lengths, self.begins = run, lengths, np.cumsum(total) - total
        self.block_of = np.repeat(np.arange(len(lengths)), total)
        place = np.arange(int(total.sum())) - self.begins[self.block_of]
        self.tokens = np.ones(len(place), np.uint64)
        self.tokens[place < lengths[self.block_of]] = words
        self.where = np.flatnonzero(place <= np.maximum(lengths[self.block_of] - run, 0))

    @classmethod
    def of(cls, blocks: list[str]) -> _Layout:
        return cls(*word_hashes(blocks), RUN)

    def hashes(self) -> np.ndarray:
        """Of the run at each token; beyond the last token there are zeros."""
        n = len(self.tokens)
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(self.tokens * POWERS(n), dtype=np.uint64))
        return near_dedup._mixed((sums[np.minimum(np.arange(n) + self.run, n)] - sums[:-1]) * INVERSES(n))

    def repeats(self, page_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Substrings of at least ``run`` tokens that occur more than once: a place of each, its length (the least
        common prefix of its interval of the suffix array), the distinct pages that have it (``page_of`` a block)."""
        runs = self.hashes()
        begins = np.zeros(len(self.tokens), bool)
        begins[self.where] = True
        order = suffix_order(self.tokens)
        order = order[begins[order]]
        # common prefixes of neighbours that agree in a whole run: by runs, then by tokens
        prefix = np.zeros(len(order), np.int64)
        i, j = order[:-1], order[1:]
        open_ = np.flatnonzero(runs[i] == runs[j]) if len(order) > 1 else np.zeros(0, np.int64)
        prefix[open_ + 1] = self.run
        for step, keys in ((self.run, np.append(runs, np.zeros(1, np.uint64))), (1, np.append(self.tokens, np.zeros(1, np.uint64)))):
            live = open_
            while len(live):
                at = prefix[live + 1]
                a, b = i[live] + at, j[live] + at
                fits = (np.maximum(a, b) + step <= len(self.tokens)) & (keys[np.minimum(a, len(self.tokens))] == keys[np.minimum(b, len(self.tokens))])
                live = live[fits]
                prefix[live + 1] += step
        head = prefix < self.run
        group = np.cumsum(head) - 1
        firsts = np.flatnonzero(head)
        pages = page_of[self.block_of[order]]
        kinds = np.unique(group * (int(pages.max(initial=0)) + 1) + pages)
        n_pages = np.bincount(kinds // (int(pages.max(initial=0)) + 1), minlength=len(firsts))
        size = np.diff(firsts, append=len(order))
        prefix[firsts] = np.iinfo(np.int64).max
        length = np.minimum.reduceat(prefix, firsts) if len(firsts) else firsts
        found = size > 1
        return order[firsts[found]], length[found], n_pages[found]

    def covered(self, chosen: np.ndarray) -> np.ndarray:
        """Whether each token is under a run at one of the chosen places of ``where``."""
        edge = np.zeros(len(self.tokens) + 1, np.int64)
        own = self.where[chosen]
        np.add.at(edge, own, 1)
        np.add.at(edge, np.minimum(own + self.run, self.begins[self.block_of[own]] + self.lengths[self.block_of[own]]), -1)
        return np.cumsum(edge[:-1]) > 0


def least_pages(pages: int) -> int:
    """Distinct pages that make a substring boilerplate on a host of so many."""
    return max(PAGES, int(np.ceil(SHARE * pages - 1e-9)))


def least_marked(pages: int) -> int:
    """... inside marked articles."""
    return max(MARKED_PAGES, int(np.ceil(MARKED_SHARE * pages - 1e-9)))


def window_candidates(pages: list[tuple[int, list[str]]], whole: bool) -> np.ndarray:
    """Hashes of the runs that may be boilerplate by this window: (class, blocks) of its distinct pages.

    A window that is not the ``whole`` host names what reaches the share of its own pages, on one page if need be.
    """
    laid = _Layout.of([b for _, blocks in pages for b in blocks])
    if not len(laid.tokens):
        return np.zeros(0, np.int64)
    n = len({c for c, _ in pages})
    least = least_pages(n) if whole else int(np.ceil(SHARE * n - 1e-9))
    if least <= 1:
        return np.unique(laid.hashes()[laid.where].view(np.int64))
    page_of = np.repeat(np.array([c for c, _ in pages], np.int64), [len(blocks) for _, blocks in pages])
    places, _, n_pages = laid.repeats(page_of)
    return np.unique(laid.hashes()[places[n_pages >= least]].view(np.int64))


def window_counts(pages: list[tuple[int, list[str]]], runs: np.ndarray) -> np.ndarray:
    """Distinct classes of the window's pages that have each of the (sorted) runs."""
    laid = _Layout.of([b for _, blocks in pages for b in blocks])
    page_of = np.repeat(np.array([c for c, _ in pages], np.int64), [len(blocks) for _, blocks in pages])
    own = laid.hashes()[laid.where].view(np.int64)
    at = np.minimum(np.searchsorted(runs, own), len(runs) - 1)
    hit = np.flatnonzero(runs[at] == own)
    kinds = np.unique(at[hit] * (len(pages) + 1) + page_of[laid.block_of[laid.where[hit]]])
    return np.bincount(kinds // (len(pages) + 1), minlength=len(runs))


def kept_texts(pages: list[tuple[list[str], bool]], some: np.ndarray, most: np.ndarray) -> list[str]:
    """The pages (blocks, whether it is marked) of one host without boilerplate: ``some`` and ``most`` are the (sorted)
    runs that enough pages of the host have, and enough for marked articles."""
    whole = ["\n".join(blocks) for blocks, _ in pages]
    if not len(some) or not any(whole):
        return whole
    laid = _Layout.of([b for blocks, _ in pages for b in blocks])
    own = laid.hashes()[laid.where].view(np.int64)
    often = np.isin(own, some)
    if not often.any():
        return whole
    under_some, under_most = laid.covered(often), laid.covered(np.isin(own, most))
    page_of = np.repeat(np.arange(len(pages)), [len(blocks) for blocks, _ in pages])
    marked = np.array([m for _, m in pages])[page_of]
    under = np.where(marked[laid.block_of], under_most, under_some)
    gone = np.bincount(laid.block_of, weights=under, minlength=len(page_of))
    n_pages = len(pages)
    mostly = np.bincount(page_of, weights=gone, minlength=n_pages) > MOSTLY * np.bincount(page_of, weights=laid.lengths, minlength=n_pages)
    first = np.searchsorted(page_of, np.arange(n_pages))
    for k in np.unique(page_of[gone > 0]).tolist():
        blocks, is_marked = pages[k]
        if is_marked and mostly[k]:
            continue
        out = []
        for j, block in enumerate(blocks, first[k]):
            if gone[j] < COVERED * laid.lengths[j]:
                cut = under_most[laid.begins[j] : laid.begins[j] + laid.lengths[j]]
                out.append(" ".join(w for w, c in zip(block.split(" "), cut) if not c) if cut.any() else block)
        whole[k] = "\n".join(out) if out else whole[k]
    return whole


def main_texts(pages: list[tuple[list[str], bool]], classes: list | None = None) -> list[str]:
    """Main text of each page of one host, given as candidate blocks and whether it marks its article.

    Pages of one class are copies and count once; without ``classes`` those of equal blocks.
    """
    kinds: dict = {}
    numbers = [kinds.setdefault(k, len(kinds)) for k in (classes or [tuple(b) for b, _ in pages])]
    window = [(c, blocks) for c, (blocks, _) in zip(numbers, pages)]
    runs = window_candidates(window, True)
    counts = window_counts(window, runs) if len(runs) else np.zeros(0, np.int64)
    return kept_texts(pages, runs[counts >= least_pages(len(kinds))], runs[counts >= least_marked(len(kinds))])


_WINDOW = ["host", "part", "parts", "id", "url", "content", "class", "blocks", "marked"]


def _windows(batches, run_col: int | None = None):
    """(host, part, parts, (class, blocks) of distinct contents, (runs, pages) of the host) of rows that are sorted by
    host and part."""
    key, pages, seen, classes, runs = None, [], set(), {}, None
    for batch in batches:
        own = [batch.column(k).to_pylist() for k in (0, 1, 2, 5, 6)]
        for row, (host, part, parts, content, class_) in enumerate(zip(*own)):
            if (host, part, parts) != key:
                if pages:
                    yield *key, pages, runs
                key, pages, seen, classes = (host, part, parts), [], set(), {}
                runs = None if run_col is None else (_array(batch.column(run_col), row), batch.column(run_col + 1)[row].as_py())
            if content is not None and content not in seen:
                seen.add(content)
                pages.append((classes.setdefault(class_, len(classes)), batch.column(7)[row].as_py()))
    if pages:
        yield *key, pages, runs


def _array(column: pa.Array, row: int) -> np.ndarray:
    """A list of numbers, sorted; none if it is null."""
    value = column[row]
    return np.sort(value.values.to_numpy()) if value.is_valid else np.zeros(0, np.int64)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: the id, the url, text (of the article, blocks joined by line feeds), n_chars (code points).

    Null and empty pages have empty text.  Rows with a null url, or one without a host, are looked at together as one
    host.  A page of which every block is shared keeps them.  Null or repeated ids don't matter: rows of equal blocks
    on a host are one page and have the same text.  An empty table gives no rows; further columns are ignored.

    Pages are shuffled once, by host and window; that exchange serves the three passes (candidates, counts, texts).
    """
    spark = df.sparkSession
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    kind, url_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "url"))
    sizes = common.staged(rows.groupBy("host").agg(F.coalesce(F.sum(F.length("html")), F.lit(0)).alias("n")), "hosts")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.filter(F.col("n") > TOGETHER).select("host", F.ceil(F.col("n") / TOGETHER).cast("int").alias("parts"))
    rows = _sent(rows, large, "host").withColumn("parts", F.coalesce("parts", F.lit(1)))

    def parse(batches):
        for batch in batches:
            for at, pages in common.runs(batch, 4, 1 << 22):
                blocks, marks, contents = [], [], []
                for own, h in zip(batch.column(2).slice(at, len(pages)).to_pylist(), pages):
                    found, marked = candidates(h)
                    blocks.append(found)
                    marks.append(marked)
                    whole = "\n".join([own, str(marked), *found]).encode("utf-8", "surrogatepass")
                    contents.append(hashlib.blake2b(whole, digest_size=16).digest() if found else None)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(pages)) for c in batch.columns[:4]), pa.array(contents, pa.binary()), pa.array(blocks, pa.list_(pa.string())), pa.array(marks, pa.bool_())], names=["id", "url", "host", "parts", "content", "blocks", "marked"])

    parsed = rows.select("id", "url", "host", "parts", "html").mapInArrow(common.returning(parse), f"id {kind}, url {url_kind}, host string, parts int, content binary, blocks array<string>, marked boolean")
    copies = _copies(parsed)
    pages = parsed.withColumn("class", F.col("content")) if copies is None else _sent(parsed, copies, "content").withColumn("class", F.coalesce("class", "content"))
    # rows without text have no class and go anywhere
    pages = pages.withColumn("part", F.pmod(F.coalesce(F.xxhash64("class"), F.xxhash64("id", "url")), F.col("parts")).cast("int"))
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (16 << 20))
    window = pages.select(*_WINDOW).repartition(n_parts, "host", "part")

    def named(batches):
        for host, part, parts, held, _ in _windows(batches):
            runs = window_candidates(held, parts == 1)
            n = len({c for c, _ in held})
            yield pa.RecordBatch.from_arrays([pa.array([host] * (len(runs) + 1)), pa.array([None, *runs.tolist()], pa.int64()), pa.array([n] + [0] * len(runs), pa.int64())], names=["host", "run", "pages"])

    found = window.sortWithinPartitions("host", "part").mapInArrow(common.returning(named), "host string, run long, pages long")
    found = found.groupBy("host").agg(F.sum("pages").alias("pages"), F.collect_set("run").alias("runs"))

    def counted(batches):
        for host, _, _, held, (runs, pages) in _windows(batches, len(_WINDOW)):
            if len(runs):
                counts = window_counts(held, runs)
                hit = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(hit), pa.string()), pa.array(runs[hit]), pa.array(counts[hit].astype(np.int64)), pa.array([pages] * len(hit), pa.int64())], names=["host", "run", "n", "pages"])

    counts = _by_window(window, found, large, ["runs", "pages"]).mapInArrow(common.returning(counted), "host string, run long, n long, pages long")
    counts = counts.groupBy("host", "run").agg(F.sum("n").alias("n"), F.first("pages").alias("pages"))
    least = lambda count, share: F.greatest(F.lit(count), F.ceil(F.lit(share) * F.col("pages") - 1e-9))
    chosen = counts.filter(F.col("n") >= least(PAGES, SHARE))
    many = F.when(F.col("n") >= least(MARKED_PAGES, MARKED_SHARE), F.col("run"))
    chosen = chosen.groupBy("host").agg(F.collect_list("run").alias("some"), F.collect_list(many).alias("most"))

    def finish(batches):
        for batch in batches:
            hosts, marks, texts, at = batch.column(0).to_pylist(), batch.column(8).to_pylist(), [], 0
            while at < len(hosts):
                end = next((k for k in range(at, len(hosts)) if hosts[k] != hosts[at] or k == at + common.SLICE), len(hosts))
                held = zip(batch.column(7).slice(at, end - at).to_pylist(), marks[at:end])
                texts += kept_texts(list(held), _array(batch.column(9), at), _array(batch.column(10), at))
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["id", "url", "text", "n_chars"])

    done = _by_window(window, chosen, large, ["some", "most"]).mapInArrow(common.returning(finish), f"id {kind}, url {url_kind}, text string, n_chars long")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def _sent(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of ``table`` where it has the key; ``table`` is broadcast while it is small."""
    small = len(table.select(key).head(SENT_ROWS + 1)) <= SENT_ROWS  # proven here; a row is a host or a digest
    return df.join(F.broadcast(table) if small else table, key, "left")


def _by_window(window: DataFrame, of_host: DataFrame, large: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the windows, sorted, with columns of their host (null where it has no row)."""
    each = of_host.join(large, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    joined = window.join(each.select("host", "part", *columns).hint("merge"), ["host", "part"], "left")
    return joined.sortWithinPartitions("host", "part").select(*_WINDOW, *columns)


def _copies(parsed: DataFrame) -> DataFrame | None:
    """content, class of the near copies among pages that don't mark their article; None if there are no such pages."""
    contents = parsed.filter("content is not null and not marked").select("content", F.array_join("blocks", "\n").alias("text"))
    contents = common.staged(contents.dropDuplicates(["content"]), "unmarked")
    if not contents.head(1):
        return None
    found = near_dedup.classes(contents, "content", "text", size=SHINGLE, threshold=NEAR)
    return common.staged(found.filter("class_size > 1").select("content", F.col("class_id").alias("class")), "copies")
