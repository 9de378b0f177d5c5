"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding turns homoglyphs, digits and signs that stand for letters into the letters, drops combining and zero-width
marks, and leaves single spaces between words.  An entry is a whole word or the beginning of one; a word counts with
its heaviest entry, unless it lies inside an exception phrase.  The weights of a text's words, as a sum, by length and
as a maximum, give its score through a logistic function.

Fitting takes a bounded sample of labelled rows (``FIT_ROWS``, chosen by the id's hash).  Entries are the terms that
are much more common in toxic texts, taken one by one, each for the toxic texts that no earlier one is in.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the lexicon is fitted on, about: a documented bound.
FIT_ROWS = 30_000
#: Terms that are looked at, shortest and longest beginnings of words among them.
CANDIDATES, SHORTEST, LONGEST = 4000, 3, 10
#: An entry is this sure to be toxic, and the only one in this share of the toxic texts (and in so many) when taken.
PRECISION, NEW_SHARE, NEW_LEAST = 0.9, 0.002, 3
#: A whole word is an entry too if it is in this share of the toxic texts that the commonest entry is in.
OFTEN = 0.3
#: Phrases in which an entry means nothing.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "rodeo clown")
#: Letters of other scripts that look like Latin ones, and signs that stand for letters (fixed values).
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ѡ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
_ZERO_WIDTH = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD, *range(0x300, 0x370)])
_FOLD = {ord(k): v for k, v in (HOMOGLYPHS | SIGNS).items()} | _ZERO_WIDTH
_ASCII = {c: " " for c in range(128) if not chr(c).isalpha() and chr(c) not in SIGNS} | {ord(k): v for k, v in SIGNS.items()}
_FOLD |= {c: v for c, v in _ASCII.items() if c not in _FOLD}


def fold(text: str) -> str:
    """Words of the folded text between single spaces, one before the first and one behind the last."""
    if text.isascii():
        text = text.lower().translate(_ASCII)
    else:
        text = unicodedata.normalize("NFKC", text).lower().translate(_FOLD)
    return " " + " ".join(text.split()) + " "


@dataclass
class Model:
    """Lexicon (" begin" or " word " with its weight), exception phrases, and the logistic function's numbers."""

    lexicon: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    logistic: tuple[float, ...] = (-2.0, 1.0, 1.0, 1.0)
    prior: float = 0.0
    _automaton: object = field(default=None, repr=False)

    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for term, weight in self.lexicon.items():
                self._automaton.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(term := fold(phrase), (len(term), 0.0))
            self._automaton.make_automaton()
        return self._automaton

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"} | {"_automaton": None}

    def features(self, text: str) -> tuple[float, float, float]:
        """Sum of the words' weights (as a logarithm), by the length of the text, and the greatest."""
        if not self.lexicon and not self.exceptions:
            return 0.0, 0.0, 0.0
        folded, best, spared = fold(text), {}, []
        for end, (size, weight) in self.automaton().iter(folded):
            begin = end - size + 1
            if weight:
                best[begin] = max(best.get(begin, 0.0), weight)
            else:
                spared.append((begin, end))
        found = [w for b, w in best.items() if not any(s <= b < e for s, e in spared)]
        total = sum(found)
        return float(np.log1p(total)), float(total / (1 + np.log1p(folded.count(" ")))), max(found, default=0.0)

    def score(self, features: np.ndarray) -> np.ndarray:
        """0 to 1; without a lexicon, the share of toxic texts among those it was fitted on."""
        if not self.lexicon:
            return np.full(len(features), min(self.prior, 0.49))
        z = self.logistic[0] + features @ np.array(self.logistic[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _terms(text: str) -> set[str]:
    """Words, and the beginnings of words, with their boundaries."""
    out = set()
    for w in set(fold(text).split()):
        if len(w) >= SHORTEST:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """text, label of about ``rows`` labelled rows at most that aren't held out; the others don't reach the join."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    share = min(1.0, rows / max(1, known.count()))
    chosen = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < int(share * (1 << 20))
    fit = lambda d: d.filter(chosen & ~held_out(id_col))
    known = fit(known).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    return fit(df).select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text")).join(known, "id").select("text", "label")


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, rows: int = FIT_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """A model from the rows whose label is known and that aren't held out; without both labels it has no lexicon."""
    sample = common.staged(labelled(df, labels, id_col, text_col, label_col, rows), "labelled")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    prior = toxic / max(1, toxic + clean)
    if not toxic or not clean:
        return Model({}, exceptions, prior=prior)

    def counted(batches):
        seen: dict[str, list[int]] = {}

        def out():
            terms = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[t][1] for t in terms], pa.int64()), pa.array([seen[t][0] for t in terms], pa.int64())], names=["term", "toxic", "clean"])

        for batch in batches:
            for text, label in zip(common.texts(batch.column(0)), batch.column(1).to_pylist()):
                for t in _terms(text):
                    seen.setdefault(t, [0, 0])[1 if label else 0] += 1
                if len(seen) > 300_000:
                    yield out()
                    seen.clear()
        yield out()

    counts = sample.mapInArrow(common.returning(counted), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sure = (F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1) >= PRECISION
    top = counts.filter((F.col("toxic") >= max(NEW_LEAST, NEW_SHARE * toxic)) & sure).orderBy(F.col("toxic").desc(), F.length("term").desc(), "term").limit(CANDIDATES).collect()
    terms = [(r["term"], r["toxic"], r["clean"]) for r in top]

    def found(batches):
        automaton = ahocorasick.Automaton()
        for k, (term, _, _) in enumerate(terms):
            automaton.add_word(term, k)
        automaton.make_automaton()
        for batch in batches:
            hits = [sorted({k for _, k in automaton.iter(fold(t))}) for t in common.texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32()))], names=["hits"])

    lexicon: dict[str, float] = {}
    if terms:
        rows_of: list[list[int]] = [[] for _ in terms]
        hits = sample.filter("label = 1").select("text").mapInArrow(common.returning(found), "hits array<int>").collect()  # bounded by the sample
        for row, r in enumerate(hits):
            for k in r["hits"]:
                rows_of[k].append(row)
        open_, sets = set(range(len(hits))), [set(r) for r in rows_of]
        while True:
            gain, _, k = max((len(s & open_), len(terms[k][0]), k) for k, s in enumerate(sets))
            if gain < max(NEW_LEAST, NEW_SHARE * toxic):
                break
            term, t, c = terms[k]
            lexicon[term] = float(np.log((t / toxic) / ((c + 0.5) / clean)))
            open_ -= sets[k]
        # whole words about as common in toxic texts as the entries: texts to come may hold no other one
        often = OFTEN * max((t for term, t, _ in terms if term in lexicon), default=0)
        for term, t, c in terms:
            if term.endswith(" ") and t >= often and not any(term.startswith(e) for e in lexicon):
                lexicon[term] = float(np.log((t / toxic) / ((c + 0.5) / clean)))
    model = Model({k: w for k, w in lexicon.items() if w > 0}, exceptions, prior=prior)

    def featured(batches):
        for batch in batches:
            each = np.array([model.features(t) for t in common.texts(batch.column(0))]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(each[:, k]) for k in range(3)), batch.column(1)], names=["a", "b", "c", "label"])

    data = sample.mapInArrow(common.returning(featured), "a double, b double, c double, label int").groupBy("a", "b", "c", "label").agg(F.count("*").alias("n")).collect()  # bounded by the sample
    x, y, n = np.array([[r["a"], r["b"], r["c"]] for r in data]), np.array([r["label"] for r in data], float), np.array([r["n"] for r in data], float)
    model.logistic = tuple(float(w) for w in logistic(x, y, n))
    return model


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression (the first is the constant) by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    ridge = penalty * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, score (0 to 1), predicted (1 from a score of 0.5), weight (the heaviest entry).

    Null and empty texts get the score of a text without entries.  Further columns are ignored; no shuffle.
    """

    def run(batches):
        for batch in batches:
            each = np.array([model.features(t) for t in common.texts(batch.column(1))]).reshape(-1, 3)
            s = model.score(each)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(each[:, 2])], names=["id", "score", "predicted", "weight"])

    rows = df.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    return rows.mapInArrow(common.returning(run), f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int, weight double").withColumnRenamed("id", id_col)


def without_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text isn't predicted to be toxic, all their columns."""

    @F.pandas_udf("boolean")
    def clean(texts):
        return texts.map(lambda t: bool(model.score(np.array([model.features(t)]))[0] < 0.5)).astype(bool)

    return df.filter(clean(common.text_of(text_col)))
