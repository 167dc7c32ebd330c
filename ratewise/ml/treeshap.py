"""ML17/ML18: exact path-dependent SHAP values of tree ensembles, as joins.

A leaf is reached when, for each feature on its path, the row's value lies in
one interval; the share of the training rows that pass a feature's splits on
the path is that feature's cover ratio z.  With o = 1 where the row's value is
inside and 0 elsewhere, a leaf of value v with m features on its path gives
feature i

    v (o_i - z_i) * sum over k of  c_k  k! (m - k - 1)! / m!

where c_k are the coefficients of the product of (z_j + o_j t) over the path's
other features (Lundberg, Erion & Lee 2018 in closed form).

A model of up to ``broadcast_nodes`` nodes is given to the tasks as the arrays
of its leaf paths, and its rows are explained where they are, batch by batch
and leaf by leaf: no row is exchanged.  k! (m - k - 1)! / m! is the integral of
t^k (1 - t)^(m - k - 1) over 0..1, so the sum is that of the product of
z_j (1 - t) + o_j t, which Gauss-Legendre points give exactly.

Larger models are explained by joins.  Tables: the node table of the fitted model (MLlib writes it, Spark reads it);
the leaf-path table made from it level by level; the patterns, that is the
distinct outcomes of a tree's splits over all rows, which decide every o, so
that no later table holds a row's values.  Rows
are joined to their patterns, patterns to leaf paths by interval, the outcomes
met there to their values, and contributions summed by group.  There no rows or
nodes are collected.
"""

from __future__ import annotations

import math
import os
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ..sources.sinks import stage
from .models import BoostedModel

#: Models of up to so many nodes are given to the tasks; MLlib holds the same
#: nodes on the driver and gives them to the tasks that score rows.
BROADCAST_NODES = 200_000
#: Rows explained at a time, leaves whose contributions are held for them, and
#: bytes of outcomes that a task works out once for all rows.
ROWS, LEAVES, OUTCOME_BYTES = 4096, 128, 64_000_000
#: Split tables of up to so many rows are broadcast to the rows; larger ones
#: are joined by shuffle.
BROADCAST_SPLITS = 100_000
#: Levels of the leaf-path table in one plan.
LEVELS = 5
_PATH = "array<struct<f:int,lo:double,hi:double,z:double>>"


def _nodes_of(spark, model, classification: bool, output: int, n_outputs: int) -> DataFrame:
    base = os.path.join(ensure_checkpoint_dir(spark), f"treeshap-{uuid.uuid4().hex}")
    model.write().overwrite().save(base)
    data = spark.read.parquet(os.path.join(base, "data"))
    if "treeID" not in data.columns:
        data = data.select(F.lit(0).alias("treeID"), F.struct(*data.columns).alias("nodeData"))
    node = F.col("nodeData")
    stats = node["impurityStats"]
    total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    if classification:
        cover, value = total, F.transform(stats, lambda x: F.try_divide(x, total))
    else:
        cover = F.get(stats, F.lit(0))
        value = F.array(*[node["prediction"] if c == output else F.lit(0.0) for c in range(n_outputs)])
    weights = [float(w) for w in getattr(model, "treeWeights", [1.0])]
    boosted = "GBT" in type(model).__name__
    weight = F.element_at(F.array(*[F.lit(w if boosted else w / len(weights)) for w in weights]), F.col("treeID") + 1)
    return data.select(
        (F.col("treeID") * n_outputs + output).alias("tree"), node["id"].alias("node"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("f"), F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("at"),
        (node["split"]["numCategories"] > 0).alias("nominal"), cover.alias("cover"), value.alias("value"), weight.alias("weight"))


def node_table(spark, model, classification: bool) -> tuple[DataFrame, int]:
    """(nodes of all trees, number of outputs): ``tree, node, left, right, f,
    at, nominal, cover, value, weight``; leaves have no children (-1).  The
    outputs of a boosted model have trees of their own."""
    if isinstance(model, BoostedModel):
        k = len(model.outputs)
        parts = [_nodes_of(spark, m, False, c, k) for c, m in enumerate(model.outputs)]
    else:
        k = model.numClasses if classification else 1
        parts = [_nodes_of(spark, model, classification, 0, k)]
    if classification:
        parts = [p.withColumn("tree", F.floor(F.col("tree") / k).cast("int")) for p in parts]
    nodes = stage(reduce(DataFrame.unionByName, parts), "tree-nodes")
    if nodes.where("nominal and left >= 0").limit(1).count():
        raise ValueError("splits by category sets have no interval")
    return nodes, k


def _extended(f, lo, hi, z):
    """The path with one more condition; a feature stands in it once."""
    seen = F.exists("path", lambda e: e["f"] == f)
    narrowed = F.transform("path", lambda e: F.when(e["f"] == f, F.struct(
        e["f"].alias("f"), F.greatest(e["lo"], lo).alias("lo"), F.least(e["hi"], hi).alias("hi"), (e["z"] * z).alias("z"))).otherwise(e))
    more = F.array(F.struct(f.cast("int").alias("f"), lo.alias("lo"), hi.alias("hi"), z.alias("z")))
    return F.when(seen, narrowed).otherwise(F.concat("path", more)).cast(_PATH)


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """``tree, leaf, value, weight, path``: a row per leaf with the interval
    (lo, hi] and the cover ratio of each feature on its path."""
    inner = nodes.where("left >= 0").select("tree", "node", "left", "right", "f", "at", "cover")
    below = nodes.select("tree", F.col("node").alias("child"), F.col("cover").alias("child_cover"), F.col("left").alias("further"),
                         "value", "weight")
    open_ = nodes.where("node = 0").select("tree", "node", F.col("left").alias("further"), "value", "weight", F.array().cast(_PATH).alias("path"))
    leaves = [open_.where("further < 0")]
    inf = F.lit(float("inf"))
    while True:
        for _ in range(LEVELS):
            at = open_.where("further >= 0").select("tree", "node", "path").join(inner, ["tree", "node"])
            sides = F.array(F.struct(F.col("left").alias("child"), (-inf).alias("lo"), F.col("at").alias("hi")),
                            F.struct(F.col("right").alias("child"), F.col("at").alias("lo"), inf.alias("hi")))
            both = at.select("tree", "path", "f", "cover", F.inline(sides)).join(below, ["tree", "child"])
            open_ = both.select("tree", F.col("child").alias("node"), "further", "value", "weight",
                                _extended(F.col("f"), F.col("lo"), F.col("hi"), F.try_divide("child_cover", "cover")).alias("path"))
            leaves.append(open_.where("further < 0"))
        open_ = stage(open_.where("further >= 0"), "tree-levels")
        leaves = [stage(reduce(DataFrame.unionByName, leaves), "tree-leaves")]
        if not open_.limit(1).count():
            return leaves[0].select("tree", F.col("node").alias("leaf"), "value", "weight", "path")


def _subset_weights(most: int):
    """k! (m - k - 1)! / m! for m = 0..most and k < m."""
    f = math.factorial
    return F.array(*[F.array(*[F.lit(f(k) * f(m - k - 1) / f(m)) for k in range(m)] or [F.lit(0.0)]) for m in range(most + 1)])


def _times(poly, e):
    """Coefficients of ``poly`` times (z + o t)."""
    low = F.concat(F.transform(poly, lambda a: a * e["z"]), F.array(F.lit(0.0)))
    high = F.concat(F.array(F.lit(0.0)), F.transform(poly, lambda a: a * e["o"]))
    return F.zip_with(low, high, lambda a, b: a + b)


def leaf_values(leaves: DataFrame, seen: DataFrame, n_outputs: int) -> DataFrame:
    """``tree, leaf, bits, parts`` for each ``tree, leaf, bits`` in ``seen``:
    what the leaf gives each feature on its path (``f, s0, s1, ...``) when the
    row's values are inside the intervals that ``bits`` names."""
    entries = F.transform("path", lambda e, i: F.struct(
        e["f"].alias("f"), F.substring("bits", i + 1, 1).cast("double").alias("o"), e["z"].alias("z")))
    most = leaves.agg(F.max(F.size("path"))).first()[0] or 0          # one number
    met = (seen.join(leaves, ["tree", "leaf"]).select("tree", "leaf", "bits", "value", "weight", entries.alias("entries"))
           .select("tree", "leaf", "bits", "value", "weight", "entries", F.posexplode("entries").alias("i", "e")))
    others = F.filter("entries", lambda y, j: j != F.col("i"))
    poly = F.aggregate(others, F.array(F.lit(1.0)), lambda acc, y: _times(acc, y))
    weight_of = F.element_at(_subset_weights(most), F.size("entries") + 1)
    share = F.aggregate(F.zip_with(poly, weight_of, lambda c, w: c * w), F.lit(0.0), lambda a, b: a + b)
    own = met.select("tree", "leaf", "bits", F.col("e.f").alias("f"), "value",
                     (F.col("weight") * (F.col("e.o") - F.col("e.z")) * share).alias("s"))
    return own.groupBy("tree", "leaf", "bits").agg(F.collect_list(
        F.struct("f", *[(F.col("value")[c] * F.col("s")).alias(f"s{c}") for c in range(n_outputs)])).alias("parts"))


def pattern_values(patterns: DataFrame, leaves: DataFrame, splits: DataFrame, n_outputs: int) -> DataFrame:
    """``tree, pattern, parts``: per pattern of a tree, ``below`` naming the
    ``splits`` whose threshold its rows don't exceed, the contribution of each
    feature (``f, s0, s1, ...``).  The ends of an interval are splits, so the
    pattern tells what is inside.  A leaf meets few of the outcomes on its path,
    so each is worked out once."""
    at = lambda e, end: F.array_position("splits", F.struct(e["f"].alias("f"), e[end].alias("at"))).cast("int")
    ends = F.transform("path", lambda e: F.struct(at(e, "lo").alias("lo"), at(e, "hi").alias("hi")))       # 0: no end
    placed = leaves.where(F.size("path") > 0).join(splits, "tree").select("tree", "leaf", ends.alias("ends"))
    is_below = lambda i: F.substring("below", i, 1) == "1"
    inside = F.transform("ends", lambda e: F.when(((e["lo"] == 0) | ~is_below(e["lo"])) & ((e["hi"] == 0) | is_below(e["hi"])), "1").otherwise("0"))
    met = patterns.join(placed, "tree").select("tree", "pattern", "leaf", F.array_join(inside, "").alias("bits"))
    values = stage(leaf_values(leaves, met.select("tree", "leaf", "bits").distinct(), n_outputs), "leaf-values")
    sums = (met.join(values, ["tree", "leaf", "bits"]).select("tree", "pattern", F.inline("parts"))
            .groupBy("tree", "pattern", "f").agg(*[F.sum(f"s{c}").alias(f"s{c}") for c in range(n_outputs)]))
    return sums.groupBy("tree", "pattern").agg(F.collect_list(F.struct("f", *[f"s{c}" for c in range(n_outputs)])).alias("parts"))


def local_paths(nodes: list) -> list[tuple]:
    """``leaf_paths`` of the collected nodes: for each leaf the features on its
    path, their intervals (lo, hi] and cover ratios, and its weighted values."""
    trees: dict = {}
    for r in nodes:
        trees.setdefault(r["tree"], {})[r["node"]] = r
    found = []
    for tree in trees.values():
        open_ = [(tree[0], {})]
        while open_:
            node, path = open_.pop()
            if node["left"] < 0:
                lo, hi, z = (np.array([e[i] for e in path.values()], dtype=float) for i in range(3))
                found.append((np.array(list(path), dtype=np.int64), lo, hi, z, np.array(node["value"], dtype=float) * node["weight"]))
                continue
            for side in ("left", "right"):
                child = tree[node[side]]
                lo, hi, z = path.get(node["f"], (-math.inf, math.inf, 1.0))
                lo, hi = (lo, min(hi, node["at"])) if side == "left" else (max(lo, node["at"]), hi)
                open_.append((child, path | {node["f"]: (lo, hi, z * (child["cover"] / node["cover"] if node["cover"] else 0.0))}))
    return found


def outcome_shares(z: np.ndarray, o: np.ndarray) -> np.ndarray:
    """What a leaf of value 1 gives each of its m features, for rows of
    outcomes ``o`` (n x m): (o_i - z_i) times the integral over 0..1 of the
    product of z_j (1 - t) + o_j t over the other features."""
    n, m = o.shape
    points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)         # exact up to degree m - 1 at least
    total = np.zeros((n, m))
    for t, w in zip((points + 1) / 2, weights / 2):
        term = z * (1 - t) + o * t
        before, after = np.ones((n, m)), np.ones((n, m))
        np.cumprod(term[:, :-1], axis=1, out=before[:, 1:])
        after[:, :-1] = np.cumprod(term[:, :0:-1], axis=1)[:, ::-1]
        total += w * before * after
    return (o - z) * total


def _bits(codes: np.ndarray, m: int) -> np.ndarray:
    return ((codes[:, None] >> np.arange(m)) & 1).astype(float)


def explain_batches(paths: list[tuple], n_features: int, k: int):
    """A function for ``mapInArrow`` on rows of ids and a last column of
    feature values: the ids and the contributions, output by output."""
    def explain(batches):
        kept, held = {}, 0          # contributions by outcome, of leaves with few features
        blocks = []
        for at in range(0, len(paths), LEAVES):
            block = [(leaf, *paths[leaf]) for leaf in range(at, min(at + LEAVES, len(paths))) if len(paths[leaf][0])]
            if block:
                f = np.concatenate([p[1] for p in block])
                values = np.concatenate([np.repeat(p[5][None, :], len(p[1]), axis=0) for p in block])
                order = np.argsort(f, kind="stable")
                place = np.empty(len(f), dtype=np.int64)
                place[order] = np.arange(len(f))
                ends = np.searchsorted(f[order], np.arange(n_features + 1))
                blocks.append((block, place, values[order], ends))
        for p in paths:
            size = 8 * len(p[0]) << len(p[0])
            held += size
            if held > OUTCOME_BYTES:
                break
            kept[len(kept)] = np.ascontiguousarray(outcome_shares(p[3], _bits(np.arange(1 << len(p[0])), len(p[0]))).T)

        def one(x: np.ndarray) -> np.ndarray:
            n = x.shape[1]
            out = np.zeros((k, n_features, n))
            for block, place, values, ends in blocks:
                shares, e = np.empty((len(place), n)), 0
                for leaf, fs, lo, hi, z, _ in block:
                    codes = np.zeros(n, dtype=np.int64)
                    for i, f in enumerate(fs):
                        # as the splits ask: NaN exceeds every threshold
                        inside = (x[f] <= hi[i]) if hi[i] < math.inf else np.ones(n, dtype=bool)
                        if lo[i] > -math.inf:
                            inside = inside & ~(x[f] <= lo[i])
                        codes |= inside.astype(np.int64) << i
                    table = kept.get(leaf)
                    if table is None:           # only the outcomes that are met
                        seen, codes = np.unique(codes, return_inverse=True)
                        table = outcome_shares(z, _bits(seen, len(fs))).T
                    for i in range(len(fs)):
                        shares[place[e]] = table[i][codes]
                        e += 1
                for f in np.flatnonzero(np.diff(ends)):
                    a, b = ends[f], ends[f + 1]
                    out[:, f] += values[a:b].T @ shares[a:b]
            return out.reshape(k * n_features, n).T

        for batch in batches:
            n = batch.num_rows
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            parts = [one(np.ascontiguousarray(x[a:a + ROWS].T, dtype=float)) for a in range(0, n, ROWS)]
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (k * n_features))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(flat))],
                                             names=[*batch.schema.names[:-1], "_s"])
    return explain


def _explained_in_place(df: DataFrame, nodes: list, k: int, feature_names: list[str], ids: list[str], features: str) -> tuple[DataFrame, DataFrame]:
    """``tree_shap`` of a model whose nodes are given to the tasks."""
    paths = local_paths(nodes)
    width = len(feature_names)
    rows = df.select(*ids, vector_to_array(F.col(features)).alias("_x"))
    schema = T.StructType([*rows.select(*ids).schema.fields, T.StructField("_s", T.ArrayType(T.DoubleType()))])
    made = rows.mapInArrow(explain_batches(paths, width, k), schema)
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("feature")) for i, n in enumerate(feature_names)])
    outputs = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.get("_s", c * width + F.col("i")))
    full = made.select(*ids, "_s", F.inline(names)).select(*ids, "feature", F.posexplode(outputs).alias("output", "shap"))
    mean = sum((p[4] * p[3].prod() for p in paths), np.zeros(k))
    expected = df.sparkSession.createDataFrame([(c, float(mean[c])) for c in range(k)], "output int, expected_value double")
    return full.select(*ids, "output", "feature", "shap"), expected


def tree_shap(df: DataFrame, model, feature_names: list[str], ids: list[str], classification: bool,
              features: str = "features", broadcast_nodes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(SHAP rows ``ids, output, feature, shap``, expected values ``output,
    expected_value``).  ``ids`` identify a row; ``output`` is the class of a
    classifier, the score column of a boosted model, else 0.  Per row and output
    all features are there, and their sum plus the expected value is the
    model's output (of boosted models the score without its start value).
    Models of up to ``broadcast_nodes`` nodes are given to the tasks, others are
    explained by joins."""
    spark = df.sparkSession
    nodes, k = node_table(spark, model, classification)
    if broadcast_nodes and nodes.count() <= broadcast_nodes:
        return _explained_in_place(df, nodes.collect(), k, feature_names, ids, features)        # bounded by broadcast_nodes
    leaves = leaf_paths(nodes)
    splits = (nodes.where("left >= 0").select("tree", "f", "at").distinct().groupBy("tree")
              .agg(F.array_sort(F.collect_list(F.struct("f", "at"))).alias("splits"), F.count("*").alias("n")))
    few = (splits.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_SPLITS
    tables = splits.drop("n")
    trees = [r["tree"] for r in splits.select("tree").collect()]        # a number for each tree with splits
    rows = df.select(*ids, vector_to_array(F.col(features)).alias("x"))
    bits = F.array_join(F.transform("splits", lambda s: F.when(F.get("x", s["f"]) <= s["at"], "1").otherwise("0")), "")
    located = (rows.select(*ids, "x", F.explode(F.array(*[F.lit(t) for t in trees]).cast("array<int>")).alias("tree"))
               .join(F.broadcast(tables) if few else tables, "tree").select(*ids, "tree", bits.alias("below")))
    pattern = F.md5(F.col("below").cast("binary")).alias("pattern")
    placed = stage(located.select(*ids, "tree", pattern), "tree-patterns")
    patterns = stage(located.select("tree", "below").distinct().select("tree", pattern, "below"), "patterns")
    values = stage(pattern_values(patterns, leaves, tables, k), "pattern-values")
    sums = (placed.join(values, ["tree", "pattern"]).select(*ids, F.inline("parts"))
            .groupBy(*ids, "f").agg(*[F.sum(f"s{c}").alias(f"s{c}") for c in range(k)]))
    per_row = sums.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("f", F.array(*[f"s{c}" for c in range(k)])))).alias("_s"))
    # features that no tree splits on, and rows without any split, have zeros
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("feature")) for i, n in enumerate(feature_names)])
    full = (df.select(*ids).join(per_row, ids, "left").select(*ids, "_s", F.inline(names))
            .select(*ids, "feature", F.posexplode(F.coalesce(F.col("_s")[F.col("i")], F.array(*[F.lit(0.0)] * k))).alias("output", "shap")))
    reached = F.aggregate(F.transform("path", lambda e: e["z"]), F.lit(1.0), lambda a, z: a * z)
    expected = (leaves.select(F.posexplode("value").alias("output", "v"), (F.col("weight") * reached).alias("w"))
                .groupBy("output").agg(F.sum(F.col("v") * F.col("w")).alias("expected_value")))
    return full.select(*ids, "output", "feature", "shap"), expected
