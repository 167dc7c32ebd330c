"""Toxicity by class-conditional Kneser-Ney models.

A word is a sequence of code points between a start and an end mark, and a
model gives each code point after the last ``order - 1`` ones a probability.
Both classes back off to the same lower orders, which are Kneser-Ney counts
over the words of *all* documents:

    P_class(c | h) = max(n_class(h c) - D, 0) / n_class(h)
                     + D * types_class(h) / n_class(h) * P_shared(c | h')

    P_shared(c | h) = the same with counts of distinct words at the highest
                      shared order and distinct left neighbours below

so an expression that one class has too seldom is judged alike by both.
``n_class`` counts documents, so one document that repeats a word does not
weigh more.  A toxic document is taken to be ordinary words mixed with toxic
ones: its likelihood of a word is ``(1 - mix) P_ordinary + mix P_toxic``.  The
two log-likelihoods of a text are compared per word, and logistic regression
on labelled rows outside the counts turns the difference into a score.

Tables of few n-grams are broadcast and each task works out the words it meets.
If one is larger than that allows, all words' log ratios are worked out by joins
of the whole tables, and texts are joined to those of their words that are not
among the commonest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .common import scratch as write_table
from .textbatch import U64, _K, flat, in_chunks, mix
from .wordlists import code_points, distinct, outside, runs, strings

START, END = 1, 2
#: Words are runs of letters and of all code points beyond ASCII.
_LETTERS = outside([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: Runs without a break are cut into words of so many code points.
LONGEST = 32
#: Distinct words that a task holds before it hands them on, and words whose
#: ratios are broadcast when the tables are not.
HELD_WORDS = 200_000
#: Words whose n-grams a task works on at a time, and bytes of labelled texts.
GRAM_WORDS, LABELLED_BYTES = 20_000, 1 << 18
#: A word's log ratio counts up to here.
MOST = 25.0


def text_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(lower-cased words, their document numbers)."""
    column = pc.utf8_lower(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    data, offsets = flat(column)
    mask = _LETTERS(data)
    starts, ends, doc = runs(mask, offsets)
    body, size = data[mask], ends - starts
    if len(size) and size.max() > LONGEST:
        lead = (body & 0xC0) != 0x80
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        points = np.cumsum(lead) - 1                       # number of each byte's code point
        within = points - np.repeat(points[at[:-1]], size)
        cuts = np.flatnonzero(lead & (within % LONGEST == 0))
        doc = np.repeat(doc, size)[cuts]
        size = np.diff(np.append(cuts, len(body)))
    return strings(body, size), doc


class Grams:
    """The n-grams of distinct words, up to ``order`` code points long; those at
    a word's beginning are shorter and begin with the start mark."""

    def __init__(self, words: pa.Array, order: int):
        chars, size = code_points(words)
        n = len(size)
        first = np.zeros(n, np.int64)
        if n:
            np.cumsum(size[:-1] + 2, out=first[1:])
        total = int(size.sum()) + 2 * n
        x = np.empty(total, np.uint64)
        word = np.repeat(np.arange(n), size + 2)
        self.depth = np.arange(total) - first[word] + 1      # code points from the word's start to here
        inner = (self.depth > 1) & (self.depth < size[word] + 2)
        x[inner] = chars
        x[first] = START
        if n:
            x[first + size + 1] = END
        self.order = order
        self.hash = [np.zeros(total, np.uint64)]
        with np.errstate(over="ignore"):
            run = np.zeros(total, np.uint64)
            for k in range(order):
                run[k:] += (x[:total - k] + U64(1)) * _K[k]
                self.hash.append(mix(run + U64(k + 1)))
        self.at = np.flatnonzero(self.depth > 1)
        self.word = word[self.at]
        self.depth = self.depth[self.at]

    def gram(self, k: int, back: int = 0) -> np.ndarray:
        """Hashes of the grams of ``k`` code points, or from the word's start;
        with ``back``, without their last ones."""
        long = np.minimum(k, self.depth) - back
        out = np.empty(len(self.at), np.uint64)
        for m in range(0, k + 1):
            here = long == m
            out[here] = self.hash[m][self.at[here] - back]
        return out.view(np.int64)


def _tally(keys: np.ndarray, *rest: np.ndarray, weights=None):
    """Distinct keys, their first values in ``rest``, and the sums of weights."""
    uniq, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
    n = np.bincount(inverse, weights, len(uniq)).astype(np.int64)
    return [uniq, *[r[at] for r in rest], n]


_GRAM_ROW = "k int, gram long, context long, suffix long, at_start boolean, n long"


def _gram_rows(grams: Grams, orders, weights=None):
    for k in orders:
        here = grams.depth >= k                    # shorter grams are those of a lower order
        w = None if weights is None else weights[grams.word][here]
        gram, ctx, low, start, n = _tally(grams.gram(k)[here], grams.gram(k, 1)[here],
                                          grams.gram(k - 1)[here] if k > 1 else np.zeros(int(here.sum()), np.int64),
                                          grams.depth[here] == k, weights=w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(gram), k, np.int32)), *[pa.array(v) for v in (gram, ctx, low, start, n)]],
            names=["k", "gram", "context", "suffix", "at_start", "n"])


def corpus_words(docs: DataFrame) -> DataFrame:
    """``word, n``: the distinct words of all documents, and how often tasks
    handed them on, which is often for those found everywhere."""

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for part in in_chunks(batch, 0, 1 << 20):
                found = distinct(text_words(part.column(0))[0])[0]
                held.append(found)
                count += len(found)
                if count >= HELD_WORDS:
                    held = [pc.unique(pa.concat_arrays(held))]
                    count = len(held[0])
                    if count >= HELD_WORDS // 2:
                        yield pa.RecordBatch.from_arrays([held[0].cast(pa.string())], names=["word"])
                        held, count = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pc.unique(pa.concat_arrays(held)).cast(pa.string())], names=["word"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word string").groupBy("word").agg(F.count("*").alias("n"))


def shared_counts(words: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """Kneser-Ney counts of all orders up to ``order`` over distinct words:
    ``k, gram, context, suffix, at_start, n``."""

    def run(batches):
        for batch in batches:
            kinds = batch.column(0).cast(pa.large_string())
            for i in range(0, len(kinds), GRAM_WORDS):
                yield from _gram_rows(Grams(kinds.slice(i, GRAM_WORDS), order), range(1, order + 1))

    grams = scratch(words.select("word").mapInArrow(run, _GRAM_ROW).groupBy("k", "gram")
                    .agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"),
                         F.first("at_start").alias("at_start"), F.sum("n").alias("n")), "toxic-grams")
    left = (grams.where("k > 1").groupBy((F.col("k") - 1).alias("k"), F.col("suffix").alias("gram"))
            .agg(F.count("*").alias("neighbours")))
    # nothing stands before a word's start, so its grams keep their own counts
    own = (F.col("k") == order) | F.col("at_start")
    return (grams.join(left, ["k", "gram"], "left")
            .select("k", "gram", "context", "suffix", "at_start", F.when(own, F.col("n")).otherwise(F.coalesce("neighbours", F.lit(1))).alias("n")))


def class_counts(docs: DataFrame, sample: DataFrame, order: int) -> DataFrame:
    """``gram, context, toxic, ordinary``: documents of the sample that hold a
    gram of the highest order, summed over their distinct words."""

    def run(batches):
        for batch in batches:
            for part in in_chunks(batch, 0, LABELLED_BYTES):
                words, doc = text_words(part.column(0))
                kinds, at = distinct(words)
                toxic = np.asarray(part.column(1).to_numpy(zero_copy_only=False), bool)
                pair = np.unique(doc * max(len(kinds), 1) + at)           # a word once in each document
                of, word = pair // max(len(kinds), 1), pair % max(len(kinds), 1)
                grams = Grams(kinds, order)
                for kind in (True, False):
                    weights = np.bincount(word[toxic[of] == kind], minlength=len(kinds))
                    # all grams that end at a code point, whole or from the word's start
                    w = weights[grams.word]
                    gram, ctx, n = _tally(grams.gram(order)[w > 0], grams.gram(order, 1)[w > 0], weights=w[w > 0])
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(ctx), pa.array(np.full(len(gram), kind)), pa.array(n)],
                                                     names=["gram", "context", "toxic", "n"])

    # the sample has a stated bound, max_train rows
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    return (found.select("text", F.col("toxic").cast("boolean")).mapInArrow(run, "gram long, context long, toxic boolean, n long")
            .groupBy("gram").agg(F.first("context").alias("context"), F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("toxic"),
                                 F.coalesce(F.sum(F.when(~F.col("toxic"), F.col("n"))), F.lit(0)).alias("ordinary")))


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default=0.0) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), *values.shape[1:]), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    out = values[at]
    out[keys[at] != wanted] = default
    return out


def _sorted(keys, *columns):
    keys = np.asarray(keys, np.int64)
    order = np.argsort(keys, kind="stable")
    return keys[order], np.stack([np.asarray(c, np.float64)[order] for c in columns], axis=1)


@dataclass
class Model:
    """Tables of a fitted pair of models, all of them sorted by hash and at
    most ``max_ngrams`` rows each."""

    order: int
    discount: float
    mix: float
    shared: list           # for each order: grams, (count,), contexts, (total, types)
    grams: tuple           # class grams, (toxic, ordinary)
    contexts: tuple        # class contexts, (total, discounted mass) of toxic, of ordinary
    symbols: int

    def lower(self, grams: Grams) -> np.ndarray:
        """P_shared of each code point."""
        p = np.full(len(grams.at), 1.0 / max(self.symbols, 1))
        for k in range(1, self.order):
            keys, n, ctx, sums = self.shared[k - 1]
            at = grams.gram(k)
            long = grams.depth >= k
            have = _lookup(keys, n, at)[:, 0]
            total = _lookup(ctx, sums, grams.gram(k, 1))
            seen = long & (total[:, 0] > 0)
            t = np.maximum(total[:, 0], 1)
            p = np.where(seen, np.maximum(have - 0.75, 0) / t + total[:, 1] / t * p, p)
        return p

    def word_ratio(self, words: pa.Array) -> np.ndarray:
        """log P_toxic - log P_ordinary of each word, where the toxic model
        mixes both."""
        grams = Grams(words, self.order)
        low = self.lower(grams)
        n = _lookup(*self.grams, grams.gram(self.order))
        c = _lookup(*self.contexts, grams.gram(self.order, 1))
        logs = []
        for i in range(2):
            total = np.maximum(c[:, 2 * i], 1)
            p = np.maximum(n[:, i] - self.discount, 0) / total + c[:, 2 * i + 1] / total * low
            logs.append(np.log(np.where(c[:, 2 * i] > 0, p, low)))
        ratio = np.bincount(grams.word, logs[0] - logs[1], len(words))
        return np.log1p(self.mix * np.expm1(np.minimum(ratio, MOST)))


class Scorer:
    """A task's scorer: it remembers the log ratios of up to ``HELD_WORDS``
    words, as texts share most of theirs."""

    def __init__(self, model: Model):
        self.model = model
        self.words, self.ratios = pa.array([], pa.large_string()), np.zeros(0)

    def word_ratio(self, words: pa.Array) -> np.ndarray:
        known = pc.index_in(words, value_set=self.words).to_numpy(zero_copy_only=False).astype(np.float64)
        out = np.empty(len(words))
        old = ~np.isnan(known)
        out[old] = self.ratios[known[old].astype(np.int64)]
        if not old.all():
            new = words.filter(pa.array(~old))
            out[~old] = np.concatenate([self.model.word_ratio(new.slice(i, GRAM_WORDS)) for i in range(0, len(new), GRAM_WORDS)])
            if len(self.words) + len(new) <= HELD_WORDS:
                self.words = pa.concat_arrays([self.words, new])
                self.ratios = np.concatenate([self.ratios, out[~old]])
        return out

    def means(self, column: pa.Array) -> np.ndarray:
        """Per text the mean of the words' log ratios, 0 without words."""
        words, doc = text_words(column)
        kinds, at = distinct(words)
        ratio = self.word_ratio(kinds)[at]
        n = np.bincount(doc, minlength=len(column))
        return np.bincount(doc, ratio, len(column)) / np.maximum(n, 1)


@dataclass
class Ratios:
    """The log ratios of all words, for counts too many to broadcast: a table
    of them, and the commonest words with theirs."""

    mix: float
    table: DataFrame       # word, ratio
    words: pa.Array
    ratios: np.ndarray


def word_ratios(words: DataFrame, shared: DataFrame, own: DataFrame, order: int, discount: float, mixture: float,
                scratch: Scratch) -> DataFrame:
    """``word, n, ratio`` of all words, as ``Model.word_ratio`` gives it, from
    whole tables: P_shared is worked out once for each gram, order by order,
    and the difference of the logs once for each gram of the highest order."""
    low = None
    for k in range(1, order):
        level = shared.where(F.col("k") == k)
        sums = level.groupBy("context").agg(F.sum("n").alias("total"), F.sum(F.least(F.col("n"), F.lit(0.75))).alias("mass"))
        below = (level.withColumn("low", F.lit(1.0 / max(level.count(), 1))) if low is None
                 else level.join(low.select(F.col("gram").alias("suffix"), F.col("p").alias("low")), "suffix"))
        p = F.greatest(F.col("n") - 0.75, F.lit(0.0)) / F.col("total") + F.col("mass") / F.col("total") * F.col("low")
        now = below.join(sums, "context").select("gram", "at_start", p.alias("p"))
        # the grams from a word's start have no higher order
        low = scratch(now if low is None else now.unionByName(low.where("at_start")), "toxic-lower")

    def kinds_of(batches):
        for batch in batches:
            kinds = batch.column(0).cast(pa.large_string())
            for i in range(0, len(kinds), GRAM_WORDS):
                yield kinds.slice(i, GRAM_WORDS), Grams(kinds.slice(i, GRAM_WORDS), order)

    def whole(batches):
        for _, grams in kinds_of(batches):
            columns = _tally(grams.gram(order), grams.gram(order, 1), grams.gram(order - 1))[:3]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["gram", "context", "suffix"])

    def held(batches):
        for kinds, grams in kinds_of(batches):
            yield pa.RecordBatch.from_arrays([kinds.take(pa.array(grams.word)).cast(pa.string()), pa.array(grams.gram(order))], names=["word", "gram"])

    alone = words.select("word")
    grams = (alone.mapInArrow(whole, "gram long, context long, suffix long").groupBy("gram")
             .agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"))
             .join(low.select(F.col("gram").alias("suffix"), F.col("p").alias("low")), "suffix")
             .join(own.select("gram", "toxic", "ordinary"), "gram", "left").join(_class_sums(own, discount, "_total"), "context", "left"))
    logs = []
    for c in ("toxic", "ordinary"):
        total = F.col(f"{c}_total")
        p = F.greatest(F.coalesce(c, F.lit(0)) - discount, F.lit(0.0)) / total + F.col(f"{c}_mass") / total * F.col("low")
        logs.append(F.log(F.when(total > 0, p).otherwise(F.col("low"))))
    grams = scratch(grams.select("gram", (logs[0] - logs[1]).alias("ratio")), "toxic-ratios")
    sums = alone.mapInArrow(held, "word string, gram long").join(grams, "gram").groupBy("word").agg(F.sum("ratio").alias("ratio"))
    return words.join(sums, "word").select("word", "n", F.log1p(mixture * F.expm1(F.least("ratio", F.lit(MOST)))).alias("ratio"))


def _class_sums(own: DataFrame, discount: float, name: str = "") -> DataFrame:
    sums = [f for c in ("toxic", "ordinary") for f in (F.sum(c).alias(f"{c}{name}"), F.sum(F.least(F.col(c), F.lit(float(discount)))).alias(f"{c}_mass"))]
    return own.groupBy("context").agg(*sums)


def fit_counts(docs: DataFrame, sample: DataFrame, order: int, discount: float, mixture: float, max_ngrams: int,
               scratch: Scratch) -> Model | Ratios:
    """The two models: their tables if none has more than ``max_ngrams`` rows,
    otherwise the log ratios that the whole tables give each word."""
    words = scratch(corpus_words(docs), "toxic-words")
    counts = scratch(shared_counts(words, order - 1, scratch), "toxic-shared")
    own = scratch(class_counts(docs, sample, order), "toxic-class")
    levels = [counts.where(F.col("k") == k) for k in range(1, order)]
    # a context is that of some gram: there are not more of them
    if max(t.count() for t in [own, *levels]) > max_ngrams:
        # kept after the call: what is returned reads it
        table = write_table(word_ratios(words, counts, own, order, discount, mixture, scratch), "toxic-words-ratios")
        common = table.orderBy(F.desc("n"), "word").limit(HELD_WORDS).select("word", "ratio").toPandas()
        return Ratios(mixture, table.select("word", "ratio"), pa.array(common["word"], pa.large_string()), common["ratio"].to_numpy(np.float64))
    shared = []
    for level in levels:
        rows = level.select("gram", "n").toPandas()
        ctx = level.groupBy("context").agg(F.sum("n").alias("n"), F.sum(F.least(F.col("n"), F.lit(0.75))).alias("mass")).toPandas()
        shared.append((*_sorted(rows["gram"], rows["n"]), *_sorted(ctx["context"], ctx["n"], ctx["mass"])))
    rows = own.select("gram", "toxic", "ordinary").toPandas()
    ctx = _class_sums(own, discount).toPandas()
    return Model(order, discount, mixture, shared, _sorted(rows["gram"], rows["toxic"], rows["ordinary"]),
                 _sorted(ctx["context"], ctx["toxic"], ctx["toxic_mass"], ctx["ordinary"], ctx["ordinary_mass"]),
                 max(len(shared[0][0]), 1))


def _by_model(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)      # max_ngrams rows a table at most

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in in_chunks(batch, 1, 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.means(part.column(1)))], names=["doc_id", "log_ratio"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, log_ratio double")


def _by_words(docs: DataFrame, fitted: Ratios) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((fitted.words, fitted.ratios))

    def run(batches):
        common, ratios = shared.value
        for batch in batches:
            for part in in_chunks(batch, 1, 1 << 20):
                words, doc = text_words(part.column(1))
                kinds, at = distinct(words)
                known = pc.fill_null(pc.index_in(kinds, value_set=common), -1).to_numpy(zero_copy_only=False)[at]
                has, size = known >= 0, part.num_rows
                total = np.bincount(doc[has], ratios[known[has]], size)
                n = np.bincount(doc, minlength=size)
                pair, times = np.unique(doc[~has] * max(len(kinds), 1) + at[~has], return_counts=True)
                of, word = pair // max(len(kinds), 1), pair % max(len(kinds), 1)
                # no word has a digit: a row that stands for its text meets none
                mark = pc.binary_join_element_wise("0", part.column(2), "")
                none = np.zeros(len(of), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([c, c.take(pa.array(of))]) for c in (part.column(0), part.column(2))]
                    + [pa.concat_arrays([mark.cast(pa.string()), kinds.take(pa.array(word)).cast(pa.string())]),
                       *[pa.array(np.concatenate(v)) for v in ((np.zeros(size, np.int64), times.astype(np.int64)), (total, none.astype(np.float64)),
                                                              (n.astype(np.int64), none), (np.ones(size, np.int64), none))]],
                    names=["doc_id", "digest", "word", "times", "total", "n", "copies"])

    # rows equal in id and text have one mean, and are told apart by their number alone
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")
    pairs = docs.select("doc_id", "text", digest).mapInArrow(run, "doc_id long, digest string, word string, times long, total double, n long, copies long")
    found = F.col("total") + F.col("times") * F.coalesce("ratio", F.lit(0.0))
    return (pairs.join(fitted.table, "word", "left").groupBy("doc_id", "digest")
            .agg(F.sum(found).alias("total"), F.sum("n").alias("n"), F.sum("copies").alias("copies"))
            .select("doc_id", (F.col("total") / F.greatest("n", F.lit(1))).alias("log_ratio"), F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc_id", "log_ratio"))


def mean_ratios(docs: DataFrame, fitted: Model | Ratios) -> DataFrame:
    """``doc_id, log_ratio`` of each row of ``docs``: the mean of the log
    ratios of its words, 0 without words."""
    return _by_model(docs, fitted) if isinstance(fitted, Model) else _by_words(docs, fitted)


def held_out(doc_id):
    """Rows whose labels are never learnt from: crc32 of the id as text is
    divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, order: int = 4, discount: float = 1.5, mixture: float = 0.003,
             max_train: int = 20_000, max_ngrams: int = 400_000) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted, log_ratio``
    (the mean difference of the log-likelihoods per word).

    Labels are learnt from at most ``max_train`` labelled rows that are not
    held out, those with the smallest hash of their id; four fifths of them
    give the counts of the classes, the rest calibrate the score.  The backoff
    counts cover all documents.  No n-gram is left out of the counts: tables of
    up to ``max_ngrams`` rows are broadcast, larger ones are joined.  Null or empty texts, and texts without words,
    have no evidence and get the calibrated score of none.  Several labels of
    one document count as one, the worst; null labels and labels of other
    documents are not used; without labels of both values the share of toxic
    rows (with half a row of each added) is every score.  Rows repeated with
    one ``doc_id`` are scored one by one; an empty table gives an empty
    result; other columns are not read."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch()
    sample = scratch(labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
                     .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
                     .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
                     .withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0), "toxic-labels")
    fitted = fit_counts(docs, sample.where("not calibrates").select("doc_id", "toxic"), order, discount,
                        mixture, max_ngrams, scratch)
    # the mean on a log scale with its sign
    x = F.signum("log_ratio") * F.asinh(F.abs(F.col("log_ratio")) * (10 / mixture))

    marked = sample.where("calibrates").select("doc_id", "toxic")
    chosen = docs.join(F.broadcast(marked.select("doc_id")), "doc_id", "left_semi")
    rows = scratch(mean_ratios(chosen, fitted).join(F.broadcast(marked), "doc_id").select("toxic", x.alias("x")), "toxic-calibration")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if positive and positive < n:
        lr = LogisticRegression(labelCol="label", featuresCol="v", regParam=1e-6, maxIter=100)
        fit = lr.fit(rows.select(F.col("toxic").cast("double").alias("label"), array_to_vector(F.array("x")).alias("v")))
        weight, bias = float(fit.coefficients[0]), float(fit.intercept)
    else:
        p = (positive + 0.5) / (n + 1)
        weight, bias = 0.0, float(np.log(p / (1 - p)))
    scratch.clear()      # what is returned reads the documents and the fitted ratios alone

    score = 1 / (1 + F.exp(-F.greatest(F.least(x * weight + bias, F.lit(30.0)), F.lit(-30.0))))
    return (mean_ratios(docs, fitted).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), "log_ratio")
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "log_ratio"))
