"""Quality by an interpolated modified Kneser-Ney model over bytes, trained on trusted text.

Counting: every trusted text of a language adds its n-grams of ``ORDER`` symbols (bytes, and marks of begin and end);
tasks count in arrays and a group-by adds up, so the counts cover all trusted text.  Lower orders count the distinct
symbols before them.  Discounts come from the counts of counts of each language and order; joins by n-gram, context
and suffix, sharded by these keys, turn counts into interpolated probabilities.

Scoring: the perplexity of each text under the model of its language.  A model of at most ``BROADCAST_ROWS`` n-grams
goes to the tasks; a larger one stays a table, and the distinct n-grams of the texts are joined with it; both read the
same numbers.  Thresholds are quantiles of the perplexity of trusted texts that aren't part of the model, by language.
A language with too few of them for its own quantile takes the quantile of all languages' perplexities, each divided by
its language's median, times its own median.  Texts in a language without trusted text are scored by the model of all
languages.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 5
#: Bits of a symbol: 0 begin, 1 to 256 bytes, 257 end.
BITS, END = 9, 257
BROADCAST_ROWS, PASSED_ROWS = 6_000_000, 500_000
#: Every so many trusted rows, by the id's hash, the model isn't trained on: thresholds come from them.
CALIBRATE = 5
#: Quantile of their perplexity that is a language's threshold; of fewer than 1 / (1 - quantile) rows it would be their
#: maximum, set by one odd text.  Where all languages together have less than twice as many, the median times FEW.
QUANTILE, FEW = 0.99, 1.25
#: Trusted ids that are broadcast at most; more of them are joined by a shuffle of the texts.
SENT_IDS = 2_000_000
#: The perplexity of a short text varies more: it is divided by exp(SHORT / sqrt(symbols)) for the comparison.
SHORT = 2.0
#: Characters whose n-grams are looked at together.
PART = 1 << 18
#: The model over all languages.
ALL = "*"


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol of the texts (end marks too), and how many each text has."""
    pad = np.zeros(ORDER - 1, np.int64)
    parts, sizes = [], []
    for t in texts:
        data = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64) + 1
        parts += [pad, data, np.array([END])]
        sizes.append(len(data) + 1)
    symbols = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    gram = np.zeros(max(0, len(symbols) - ORDER + 1), np.int64)
    for k in range(ORDER):
        gram |= symbols[k : len(symbols) - ORDER + 1 + k] << (BITS * (ORDER - 1 - k))
    own = np.ones(len(gram), bool)  # the windows that end in the padding of a later text
    ends = np.cumsum(np.array(sizes, np.int64) + ORDER - 1) - (ORDER - 1)
    for k in range(ORDER - 1):
        at = ends[:-1] + k
        own[at] = False
    return gram[own], np.array(sizes, np.int64)


def count_grams(rows: DataFrame) -> DataFrame:
    """lang, gram, n over all rows (lang, text); a row counts for its language and for all."""

    def run(batches):
        held: dict[str, list] = {}

        def out(lang: str):
            grams, counts = _summed(held.pop(lang))
            for at in range(0, len(grams), 200_000):
                part = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams[part]), pa.string()), pa.array(grams[part]), pa.array(counts[part])], names=["lang", "gram", "n"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, texts in common.runs(batch, 1, PART):
                by: dict[str, list[str]] = {}
                for lang, text in zip(langs[at : at + len(texts)], texts):
                    by.setdefault(lang, []).append(text)
                for lang, part in by.items():
                    grams, n = np.unique(_grams(part)[0], return_counts=True)
                    own = held.setdefault(lang, [])
                    own.append((grams, n.astype(np.int64)))
                    if len(own) > 16:
                        held[lang] = [_summed(own)]
                    if len(held[lang][0][0]) > 2_000_000:
                        yield from out(lang)
        for lang in list(held):
            yield from out(lang)

    each = rows.mapInArrow(common.returning(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    each = common.staged(each, "grams")
    return each.filter(F.col("lang") != ALL).unionByName(each.groupBy("gram").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(ALL)))


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(back, weights=np.concatenate([n for _, n in parts]), minlength=len(grams)).astype(np.int64)


def discounts(orders: dict[int, DataFrame]) -> dict[int, list[tuple[str, float, float, float]]]:
    """By order: (language, discounts of the counts 1, 2, and 3 or more), from the counts of counts up to 4."""
    few = [orders[k].filter("n <= 4").groupBy("lang", "n").agg(F.count("*").alias("rows")).withColumn("size", F.lit(k)) for k in orders]
    tallies: dict[tuple[int, str], dict[int, int]] = {}
    for r in reduce(DataFrame.unionByName, few).collect():  # four numbers for each language and order
        tallies.setdefault((r["size"], r["lang"]), {})[r["n"]] = r["rows"]
    found: dict[int, list] = {k: [] for k in orders}
    for (size, lang), n in tallies.items():
        n1, n2 = n.get(1, 0), n.get(2, 0)
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        cut = (min(float(j), max(0.1, j - (j + 1) * y * n[j + 1] / n[j])) if n.get(j) and n.get(j + 1) else 0.75 for j in (1, 2, 3))
        found[size].append((lang, *cut))
    return found


def probabilities(counts: DataFrame) -> DataFrame:
    """lang, size, gram, is_back, value: of each n-gram of ``size`` symbols its interpolated log probability, and of each
    one that is a context (``is_back``) the logarithm of what an unseen continuation is multiplied by."""
    spark, orders = counts.sparkSession, {ORDER: counts.select("lang", "gram", "n")}
    width = common.width(counts.count())
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND((1 << (BITS * k)) - 1)
        orders[k] = common.staged(orders[k + 1].groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("n")).coalesce(width), f"order{k}")
    cuts, low, tables = discounts(orders), None, []
    for k in range(1, ORDER + 1):
        own = spark.createDataFrame(cuts[k], "lang string, d1 double, d2 double, d3 double")  # one row a language
        # a language whose n-grams all have more than four occurrences has no counts of counts
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = orders[k].join(F.broadcast(own), "lang", "left").withColumn("d", F.coalesce(d, F.lit(0.75))).withColumn("context", F.shiftright("gram", BITS))
        totals = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("kept"))
        totals = common.staged(totals.coalesce(width), f"contexts{k - 1}")
        joined = rows.join(totals, ["lang", "context"])
        lower = F.lit(1.0 / (END + 1))
        if low is not None:
            before = low.select("lang", F.col("gram").alias("suffix"), F.exp("logp").alias("lower"))
            joined, lower = joined.withColumn("suffix", F.col("gram").bitwiseAND((1 << (BITS * (k - 1))) - 1)).join(before, ["lang", "suffix"]), F.col("lower")
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("kept") / F.col("total") * lower
        low = common.staged(joined.select("lang", "gram", F.log(p).alias("logp")).coalesce(width), f"model{k}")
        tables.append(low.select("lang", F.lit(k).alias("size"), "gram", F.lit(False).alias("is_back"), F.col("logp").cast("float").alias("value")))
        tables.append(totals.select("lang", F.lit(k - 1).alias("size"), F.col("context").alias("gram"), F.lit(True).alias("is_back"), F.log(F.col("kept") / F.col("total")).cast("float").alias("value")))
    return common.staged(reduce(DataFrame.unionByName, tables).coalesce(width), "model")


class Model:
    """Lookups in one language's model, with a direct-mapped cache of resolved n-grams."""

    SLOTS = 1 << 18

    def __init__(self, tables: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]):
        self.tables = tables
        self.keys, self.values = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS)

    def _find(self, size: int, is_back: bool, gram: np.ndarray, missing: float) -> np.ndarray:
        keys, values = self.tables.get((size, is_back), (np.zeros(0, np.int64),) * 2)
        if not len(keys):
            return np.full(len(gram), missing)
        at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
        return np.where(keys[at] == gram, values[at], missing)

    def resolve(self, gram: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram's last symbol after the others."""
        out, open_, weight = np.zeros(len(gram)), np.arange(len(gram)), np.zeros(len(gram))
        for size in range(ORDER, 0, -1):
            own = gram[open_] & ((1 << (BITS * size)) - 1)
            logp = self._find(size, False, own, np.nan)
            seen = ~np.isnan(logp)
            out[open_[seen]] = logp[seen] + weight[open_[seen]]
            open_, own = open_[~seen], own[~seen]
            weight[open_] += self._find(size - 1, True, own >> BITS, 0.0)
        out[open_] = weight[open_] - np.log(END + 1)
        return out

    def log_probabilities(self, gram: np.ndarray) -> np.ndarray:
        slot = ((gram * 0x9E3779B97F4A7C1) >> 20) & (self.SLOTS - 1)
        out = self.values[slot]
        missing = np.flatnonzero(self.keys[slot] != gram)
        if len(missing):
            kinds, back = np.unique(gram[missing], return_inverse=True)
            found = self.resolve(kinds)
            out[missing] = found[back]
            at = ((kinds * 0x9E3779B97F4A7C1) >> 20) & (self.SLOTS - 1)
            self.keys[at], self.values[at] = kinds, found
        return out


def _lang(known: list[str], lang_col: str) -> Column:
    """The model that a row is scored with."""
    lang = F.col(lang_col).cast("string")
    return F.when(lang.isin(known), lang).otherwise(F.lit(ALL)) if known else F.lit(ALL)


def perplexities(df: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """id, digest (of the text), model (its language), perplexity, symbols (scored): one row per input row."""
    sizes: dict[str, dict[int, int]] = {}
    for r in model.groupBy("lang", "size").agg(F.count("*").alias("n")).collect():  # some for each language
        sizes.setdefault(r["lang"], {})[r["size"]] = r["n"]
    rows = df.select(F.col(id_col).alias("id"), F.unhex(F.sha2(common.text_of(text_col), 256)).alias("digest"), _lang([k for k in sizes if k != ALL], lang_col).alias("model"), common.text_of(text_col).alias("text"))
    if sum(n for own in sizes.values() for n in own.values()) > broadcast_rows:
        return _by_join(rows, model)
    kind = rows.schema["id"].dataType.simpleString()
    arrays: dict[str, dict] = {}
    for lang, own in sizes.items():
        arrays[lang], orders = {}, sorted(own)
        while orders:  # a part of a language passes the driver at once
            n = next((k for k in range(1, len(orders)) if sum(own[o] for o in orders[: k + 1]) > PASSED_ROWS), len(orders))
            part = model.filter((F.col("lang") == lang) & F.col("size").isin(orders[:n])).select("size", "is_back", "gram", "value").toArrow()
            code = part.column(0).to_numpy() * 2 + part.column(1).to_numpy(zero_copy_only=False)
            gram, value = part.column(2).to_numpy(), part.column(3).to_numpy()
            order = np.lexsort((gram, code))
            for k in np.unique(code).tolist():
                at = order[np.searchsorted(code, k, sorter=order) : np.searchsorted(code, k, side="right", sorter=order)]
                arrays[lang][k // 2, bool(k % 2)] = gram[at], value[at]
            del part, gram, value, order
            orders = orders[n:]
    sent = df.sparkSession.sparkContext.broadcast(arrays)

    def run(batches):
        models: dict[str, Model] = {}
        for batch in batches:
            out, symbols = np.full(batch.num_rows, np.nan), np.zeros(batch.num_rows, np.int64)
            langs = np.array(batch.column(2).to_pylist(), object)
            for begin, texts in common.runs(batch, 3, PART):
                own = langs[begin : begin + len(texts)]
                for lang in set(own.tolist()):
                    at = np.flatnonzero(own == lang)
                    grams, sizes = _grams([texts[k] for k in at])
                    symbols[begin + at] = sizes
                    if lang in sent.value:
                        if lang not in models:
                            models[lang] = Model(sent.value[lang])
                        out[begin + at] = np.exp(-common.sums(models[lang].log_probabilities(grams), sizes) / sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, from_pandas=True), pa.array(symbols)], names=["id", "digest", "model", "perplexity", "symbols"])

    return rows.mapInArrow(common.returning(run), f"id {kind}, digest binary, model string, perplexity double, symbols long")


def _by_join(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Perplexities from the model as a table: the texts' distinct n-grams are resolved by joins, order by order."""
    rows = common.staged(rows.withColumn("row", F.monotonically_increasing_id()), "texts")

    def run(batches):
        for batch in batches:
            for at, texts in common.runs(batch, 2, PART):
                grams, sizes = _grams(texts)
                text = np.repeat(np.arange(len(texts)), sizes)
                order = np.lexsort((grams, text))
                grams, text = grams[order], text[order]
                first = np.flatnonzero(np.append(True, (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])))
                own = pa.array(text[first] + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(grams[first]), pa.array(np.diff(first, append=len(grams)))], names=["row", "lang", "gram", "n"])

    grams = common.staged(rows.select("row", "model", "text").mapInArrow(common.returning(run), "row long, lang string, gram long, n long"), "text-grams")
    kinds = grams.select("lang", "gram").distinct().withColumns({"weight": F.lit(0.0), "logp": F.lit(None).cast("double")})
    for size in range(ORDER, 0, -1):
        own = model.filter((F.col("size") == size) & ~F.col("is_back")).select("lang", F.col("gram").alias("own"), F.col("value").cast("double").alias("seen"))
        before = model.filter((F.col("size") == size - 1) & F.col("is_back")).select("lang", F.col("gram").alias("context"), F.col("value").cast("double").alias("back"))
        kinds = kinds.withColumn("own", F.col("gram").bitwiseAND((1 << (BITS * size)) - 1)).join(own, ["lang", "own"], "left")
        kinds = kinds.withColumn("context", F.shiftright("own", BITS)).join(before, ["lang", "context"], "left")
        known = F.coalesce("logp", F.col("weight") + F.col("seen"))
        kinds = kinds.select("lang", "gram", (F.col("weight") + F.coalesce("back", F.lit(0.0))).alias("weight"), known.alias("logp"))
    kinds = common.staged(kinds.select("lang", "gram", F.coalesce("logp", F.col("weight") - float(np.log(END + 1))).alias("logp")), "resolved")
    each = grams.join(kinds, ["lang", "gram"]).groupBy("row").agg(F.exp(-F.sum(F.col("n") * F.col("logp")) / F.sum("n")).alias("perplexity"), F.sum("n").alias("symbols"))
    return rows.drop("text").join(each, "row").select("id", "digest", "model", "perplexity", "symbols")


def trusted_rows(df: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """id of the rows labelled 1 in ``labels``, each once."""
    return labels.filter((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("trusted_id")).distinct()


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", *, quantile: float = QUANTILE, broadcast_rows: int = BROADCAST_ROWS, held_out: Column | None = None) -> DataFrame:
    """One row per input row: the id, digest (of its text), model (language of the model that scored it), perplexity,
    threshold, kept.

    Trusted are the rows that ``labels`` gives 1, but for those of ``held_out``.  One in CALIBRATE of them isn't
    trained on.  A text is kept if its perplexity, allowing for its length, is at most the threshold of its model,
    their ``quantile`` in its language (of fewer than 1 / (1 - quantile) rows the pooled one).  Null counts as empty, which
    is one end mark; null or unknown languages use the model of all languages.  Without any trusted text nothing is
    known: perplexity and threshold are null and all rows are kept.  Further columns are ignored.
    """
    trusted = trusted_rows(df, labels, id_col, label_col)
    chosen = df if held_out is None else df.filter(~held_out)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    own = chosen.select(F.col(id_col).alias("id"), lang.alias("lang"), common.text_of(text_col).alias("text"))
    apart = F.pmod(F.xxhash64(F.col("trusted_id").cast("string")), F.lit(CALIBRATE)) == 0
    learnt = common.staged(trusted.filter(~apart), "trusted")
    learnt = F.broadcast(learnt) if learnt.count() <= SENT_IDS else learnt  # eight bytes each, counted
    own = own.join(learnt, own["id"] == F.col("trusted_id"), "left_semi").select("lang", "text")
    model = probabilities(common.staged(count_grams(own), "counts"))
    scores = common.staged(perplexities(df, model, id_col, text_col, lang_col, broadcast_rows=broadcast_rows), "perplexities")
    fair = F.col("perplexity") * F.exp(-SHORT / F.sqrt("symbols"))
    known = scores.join(trusted.filter(apart), scores["id"] == F.col("trusted_id"), "left_semi")
    known = known.select("model", fair.alias("fair"))
    own_ = known.groupBy("model").agg(F.count("*").alias("n"), F.percentile_approx("fair", 0.5, 100_000).alias("median"), F.percentile_approx("fair", quantile, 100_000).alias("own"))
    own_ = common.staged(own_, "limits")
    enough = lambda n: n * (1 - quantile) >= 1 - 1e-9
    ratio = F.when(enough(F.count("*") / 2), F.percentile_approx(F.col("fair") / F.col("median"), quantile, 100_000)).otherwise(FEW)
    ratio = known.join(F.broadcast(own_), "model").agg(ratio).first()[0]
    everywhere = known.agg(F.percentile_approx("fair", 0.5, 100_000)).first()[0]
    limits = scores.select("model").distinct().join(own_, "model", "left")  # one row a language
    pooled = F.coalesce("median", F.lit(everywhere).cast("double")) * F.lit(ratio).cast("double")
    limits = limits.select("model", F.when(enough(F.col("n")), F.col("own")).otherwise(pooled).alias("threshold"))
    kept = F.coalesce(fair <= F.col("threshold"), F.lit(True))
    return scores.join(F.broadcast(limits), "model").select(F.col("id").alias(id_col), "digest", "model", "perplexity", "threshold", kept.alias("kept"))


def without_rejected(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that ``classify`` keeps, all their columns, repeated rows too."""
    kept = classify(df, labels, id_col, text_col, **options).filter("kept").select(F.col(common.quoted(id_col)).alias("id"), "digest").distinct()
    digest = F.unhex(F.sha2(common.text_of(common.quoted(text_col)), 256))
    own = df.select(F.struct(*(F.col(common.quoted(c)).alias(c) for c in df.columns)).alias("row"), F.col(common.quoted(id_col)).alias("own_id"), digest.alias("own_digest"))
    match = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_digest") == F.col("digest"))
    return own.join(kept, match, "left_semi").select(*(F.col("row").getField(c).alias(c) for c in df.columns))
