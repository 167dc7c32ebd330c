"""Quality classifier with hierarchical empirical Bayes.

Document evidence: shares of byte classes, repetition and length of a text,
and word evidence.  The word evidence is learnt by grouped counts over the
labelled training rows (log odds of a word among documents with and without a
label, shrunk to the prior); logistic regression turns all of it into a
probability for each label.

Site evidence: documents belong to a host, and to a path below it.  Grouped
sums of the document probabilities give each host a posterior mean that is
shrunk to the global mean, and each path one that is shrunk to its host's; how
strongly, the spread between the groups tells (method of moments), so sparse
sites stay near the prior.  A document's own probability is taken out of its
site's sums before they are combined.

Combination: logit(p) = logit(document) + weight * (logit(path posterior
without the document) - logit(global mean)).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom_of, scratch
from .textbatch import SPACE, U64, byte_class, flat, in_chunks, word_hashes, word_spans

#: Byte classes, each a share of the text's bytes.
_CLASSES = ["upper", "lower", "digit", "space", "stop", "bang", "bar", "sign", "wide"]


def _class_table() -> np.ndarray:
    t = np.full(256, _CLASSES.index("sign"), np.uint8)
    for name, bytes_ in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)),
                         ("space", np.flatnonzero(SPACE)), ("stop", b".,;:'\"()-"), ("bang", b"!?"), ("bar", b"|"),
                         ("wide", range(128, 256))):
        t[list(bytes_)] = _CLASSES.index(name)
    return t


_TABLE = _class_table()
#: Words end at every ASCII byte but letters, so marks don't split the evidence.
_BORDER = byte_class([(0, 64), (91, 96), (123, 127)])
FEATURES = [f"share_{c}" for c in _CLASSES] + ["word_bytes", "distinct", "repeats", "log_words"]


#: Word beginnings, in bytes, that are evidence besides whole words: they
#: carry over to word forms that the training rows don't have.
BEGINNINGS = (5, 7, 9)


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, word hashes, their document numbers) of a batch of texts; the
    hashes are of whole words and of word beginnings, not in order.  An empty
    text has zeros."""
    data, offsets = flat(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, len(FEATURES)), np.float64)
    of = np.repeat(np.arange(n), size)
    out[:, :len(_CLASSES)] = np.bincount(of * len(_CLASSES) + _TABLE[data], minlength=n * len(_CLASSES)).reshape(n, -1)
    out[:, :len(_CLASSES)] /= np.maximum(size, 1)[:, None]
    starts, ends, counts = word_spans(data, offsets, _BORDER)
    words = word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(n), counts)
    total = np.maximum(counts, 1)
    out[:, -4] = np.bincount(doc, ends - starts, minlength=n) / total
    last = np.cumsum(counts)
    out[:, -3] = [len(np.unique(words[e - c:e])) / max(c, 1) for e, c in zip(last.tolist(), counts.tolist())]
    same = np.concatenate([[False], (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])]) if len(words) else np.zeros(0, bool)
    out[:, -2] = np.bincount(doc, same, minlength=n) / total
    out[:, -1] = np.log1p(counts)
    found, docs = [words], [doc]
    for m in BEGINNINGS:
        long = ends - starts > m
        found.append(word_hashes(data, starts[long], starts[long] + m) + U64(m))
        docs.append(doc[long])
    return out, np.concatenate(found), np.concatenate(docs)


class Evidence:
    """Log odds of words for each label, as sorted arrays."""

    def __init__(self, rows, labels):
        rows = sorted(rows)
        self.words = np.array([r[0] for r in rows], np.int64)
        self.odds = np.array([r[1:] for r in rows], np.float64).reshape(len(rows), len(labels))
        self.low = np.zeros(1 << 16, bool)      # which low bits occur: most words end here
        self.low[self.words & 0xFFFF] = True

    def features(self, words: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Per label three numbers of the log odds of the known words in a text:
        the largest, the sum over distinct words, the sum over all places."""
        k = self.odds.shape[1]
        out = np.zeros((n, 3 * k))
        if not len(self.words) or not len(words):
            return out
        w = words.view(np.int64)
        maybe = np.flatnonzero(self.low[w & 0xFFFF])
        at = np.minimum(np.searchsorted(self.words, w[maybe]), len(self.words) - 1)
        hit = self.words[at] == w[maybe]
        pair, places = np.unique(doc[maybe[hit]] * len(self.words) + at[hit], return_counts=True)
        of, word = pair // len(self.words), pair % len(self.words)
        for j in range(k):
            odds = self.odds[word, j]
            np.maximum.at(out[:, 3 * j], of, odds)
            out[:, 3 * j + 1] = np.bincount(of, odds, minlength=n)
            out[:, 3 * j + 2] = np.log1p(np.bincount(of, odds * places, minlength=n))
        return out


LABELS = ("bad", "toxic")


def training_labels(labels: DataFrame, max_train: int) -> DataFrame:
    """``doc_id, bad, toxic``: at most ``max_train`` labelled rows, those with
    the smallest hash of their id.  Several labels of one document count as
    one, the worst of them; a null label is not used."""
    return (labels.where("doc_id is not null").groupBy("doc_id")
            .agg(F.max(1 - F.col("quality")).cast("double").alias("bad"), F.max("toxic").cast("double").alias("toxic"))
            .where("bad is not null or toxic is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, max_words: int = 4096, least_docs: int = 4,
        least_strength: float = 5.0):
    """``(evidence, {label: (weights, intercept)})`` from a bounded sample of
    the labelled rows.  A label without both values gets its prior alone."""
    sample = scratch(training_labels(labels, max_train), "labels")
    wanted = docs.sparkSession.sparkContext.broadcast(bloom_of(sample, "doc_id", max_train))

    def featurise(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy().astype(np.int64)
            found = batch.filter(pa.array(wanted.value.has(ids.view(np.uint64))))
            for part in in_chunks(found, 1, 1 << 20) if found.num_rows else ():
                x, words, doc = text_features(part.column(1))
                order = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[order], np.arange(1, len(x)))
                sets = [w.view(np.int64) for w in np.split(words[order], cuts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64())),
                                                  pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "x", "words"])

    rows = scratch(docs.where("doc_id is not null").mapInArrow(featurise, "doc_id long, x array<double>, words array<long>")
                   .dropDuplicates(["doc_id"]).join(sample, "doc_id"), "training")
    total = rows.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in LABELS], *[F.count(c).alias(f"n_{c}") for c in LABELS]).first()
    odds, strength = [], []
    # all words of enough positive rows, counted over all training rows
    positive = (F.col("bad") == 1) | (F.col("toxic") == 1)
    counts = (rows.select(F.explode(F.array_distinct("words")).alias("word"), *LABELS).groupBy("word")
              .agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in LABELS], *[F.count(c).cast("double").alias(f"n_{c}") for c in LABELS],
                   F.greatest(*[F.sum(F.when(positive, F.col(c))) for c in LABELS]).alias("n"))
              .where(F.col("n") >= least_docs))
    for c in LABELS:
        n, pos = total[f"n_{c}"] or 0, total[c] or 0.0
        prior = (pos + 0.5) / (n + 1)
        # the share among the documents with the word, with two documents of the prior added
        share = (F.col(c) + 2 * prior) / (F.col(f"n_{c}") + 2)
        o = F.log(share / (1 - share)) - F.lit(float(np.log(prior / (1 - prior))))
        odds.append(F.greatest(o, F.lit(0.0)).alias(f"odds_{c}"))
        # in standard deviations of what chance gives: words that few documents have stay out
        strength.append((F.col(c) - F.col(f"n_{c}") * prior) / F.sqrt(F.greatest(F.col(f"n_{c}"), F.lit(1.0)) * prior * (1 - prior)))
    best = (counts.where(F.greatest(*[F.col(f"n_{c}") for c in LABELS]) >= least_docs)
            .select("word", *odds, F.greatest(*strength).alias("strength")).where(F.col("strength") > least_strength)
            .orderBy(F.desc("strength"), "word").limit(max_words).drop("strength").collect())
    evidence = Evidence([tuple(r) for r in best], LABELS)

    def add_evidence(batches):
        for batch in batches:
            lists = batch.column(2).combine_chunks() if isinstance(batch.column(2), pa.ChunkedArray) else batch.column(2)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            more = evidence.features(lists.flatten().to_numpy().view(np.uint64), doc, batch.num_rows)
            x = np.concatenate([np.stack(batch.column(1).to_pylist()), more], axis=1) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), *batch.columns[3:]],
                                             names=["x", *LABELS])

    table = scratch(rows.select("doc_id", "x", "words", *LABELS).mapInArrow(
        add_evidence, "x array<double>, bad double, toxic double"), "features")
    models = {}
    size = len(FEATURES) + 3 * len(LABELS)
    for c, default in zip(LABELS, (0.5, 0.1)):
        n, pos = total[f"n_{c}"] or 0, total[c] or 0.0
        if pos and pos < n:
            lr = LogisticRegression(labelCol=c, featuresCol="v", regParam=1e-4, maxIter=60)
            m = lr.fit(table.where(F.col(c).isNotNull()).select(c, array_to_vector("x").alias("v")))
            models[c] = (m.coefficients.toArray(), float(m.intercept))
        else:
            p = (pos + default) / (n + 1)
            models[c] = (np.zeros(size), float(np.log(p / (1 - p))))
    return evidence, models


def score(docs: DataFrame, columns: list[str], evidence: Evidence, models) -> DataFrame:
    """``doc_id, <columns>, p_document, p_toxic`` from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((evidence, [models[c] for c in LABELS]))   # max_words rows at most

    def run(batches):
        found, fitted = shared.value
        for batch in batches:
            for part in in_chunks(batch, 1, 1 << 20):
                x, words, doc = text_features(part.column(1))
                x = np.concatenate([x, found.features(words, doc, len(x))], axis=1)
                bad, toxic = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) for w, b in fitted)
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(1 - bad), pa.array(toxic)],
                                                 names=["doc_id", *names, "p_document", "p_toxic"])

    names = [f"site_{i}" for i in range(len(columns))]
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(columns, names)])
    return src.mapInArrow(run, ", ".join(["doc_id long", *[f"{n} string" for n in names], "p_document double", "p_toxic double"]))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, n: str, total: str, prior: Column) -> float:
    """Prior strength in documents, by the method of moments: the spread of
    the group means around their priors beyond what sampling explains."""
    mean = F.col(total) / F.col(n)
    r = groups.agg(F.count("*").alias("g"), F.sum(n).alias("n"), F.sum(F.col(n) * (mean - prior) ** 2).alias("s"),
                   F.sum(F.col(n) * prior * (1 - prior)).alias("v")).first()
    if not r["g"] or not r["n"]:
        return 1e6
    within = (r["v"] or 0.0) / r["n"]
    between = max(0.0, (r["s"] or 0.0) / r["n"] - within * r["g"] / r["n"])
    return float(min(1e6, max(1.0, within / between))) if between > 0 else 1e6


def quality_classifier(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_train: int = 20_000,
                       weight: float = 0.5, least_quality: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """Per row of ``docs``: ``doc_id, host, path, p_document, host_posterior,
    path_posterior, p_quality, p_toxic, kept``.

    ``host`` and ``path`` name columns (a path is a pair of both); null is a
    site of its own, named by the empty string.  Null or empty text is scored
    like a text without words.  Rows repeated with one ``doc_id`` are scored
    one by one; all of them count in their sites.  Labels of documents that
    are not in ``docs`` are not used; without labels the priors 0.5 (quality)
    and 0.1 (toxic) decide, which keeps everything.  An empty table gives an
    empty result.  ``max_train`` bounds the labelled rows that the classifier
    is fitted on; the site posteriors are sums over all documents.  A document
    is kept when ``p_quality >= least_quality`` and ``p_toxic < most_toxic``."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    evidence, models = fit(src, labels, max_train)
    scored = scratch(score(docs, [host, path], evidence, models)
                     .withColumnsRenamed({"site_0": "host", "site_1": "path"}), "scored")
    whole = scored.agg(F.avg("p_document")).first()[0]
    mean = F.lit(0.5 if whole is None else float(min(1 - 1e-6, max(1e-6, whole))))
    paths = scratch(scored.groupBy("host", "path").agg(F.count("*").alias("n_path"), F.sum("p_document").alias("s_path")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))
    k_host = _strength(hosts, "n_host", "s_host", mean)
    hosts = hosts.withColumn("host_posterior", (k_host * mean + F.col("s_host")) / (k_host + F.col("n_host")))
    sites = paths.join(hosts, "host")
    k_path = _strength(sites, "n_path", "s_path", F.col("host_posterior"))
    own = F.col("p_document")
    host_rest = (k_host * mean + F.col("s_host") - own) / (k_host + F.col("n_host") - 1)
    path_rest = (k_path * host_rest + F.col("s_path") - own) / (k_path + F.col("n_path") - 1)
    p = _logit(own) + weight * (_logit(path_rest) - _logit(mean))
    return (scored.join(sites, ["host", "path"])
            .select("doc_id", "host", "path", "p_document", "host_posterior",
                    ((k_path * F.col("host_posterior") + F.col("s_path")) / (k_path + F.col("n_path"))).alias("path_posterior"),
                    (1 / (1 + F.exp(-p))).alias("p_quality"), "p_toxic")
            .withColumn("kept", (F.col("p_quality") >= least_quality) & (F.col("p_toxic") < most_toxic)))
