"""Exact statistics of every level of many factors (AGG2) without a row for
each policy, factor and measure.

1. A few hundred points of each measure cut its values into cells: cell 2 i + 1
   is the value of point i, cell 2 i what lies between the points around it.
2. The rows are read once.  A task codes levels and values as numbers and counts
   its rows by group (by, factor, level, measure) and cell; count, sum, least
   and greatest value of the cells are added up by Spark.
3. Running counts over the cells of a group tell the cell of every rank that a
   quantile needs.  Its value is known if the cell has one value, or if the
   rank is the first or the last of the cell.
4. For the others the rows are read again: values of just those cells are
   counted, and ranked within their cell.

A group is never in one task: the largest thing that is, is the values of one
cell of one group.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import stage
from .quantiles import MAX_BUCKETS, bucket_of

#: Points of a measure, at least; more for more rows than so many a point.
POINTS = 128
#: Rows that a task counts at a time, and cells that it holds as one array.
CHUNK, DENSE = 200_000, 4_000_000
#: Cells whose values are wanted that are given to the tasks; more are joined.
BROADCAST_CELLS = 100_000


def measure_points(df: DataFrame, measures: list[str], per_point: int, least: int = POINTS) -> list[list[float]]:
    """Quantiles of each measure.  Any value that more rows have than a point
    stands for is among them, so it has a cell of its own."""
    n = min(MAX_BUCKETS, max(least, -(-df.count() // per_point)))
    found = df.select(*measures).approxQuantile(measures, [i / n for i in range(n + 1)], 1.0 / (4 * n))
    return [sorted({p + 0.0 for p in points}) for points in found]


def _cell(v: np.ndarray, points: np.ndarray) -> np.ndarray:
    at = np.searchsorted(points, v)
    equal = (points[np.minimum(at, len(points) - 1)] == v) if len(points) else np.zeros(len(v), dtype=bool)
    return 2 * at + equal


def cell_of(v, points: list[float]):
    """``_cell`` as a column; NULL has cell -1."""
    at = bucket_of(v, points)
    equal = F.coalesce(F.get(F.array(*[F.lit(p) for p in points]).cast("array<double>"), at) == v, F.lit(False))
    return F.when(v.isNull(), -1).otherwise(2 * at + equal.cast("int"))


class _Coded:
    """Rows of a task as numbers: a code for each group of a factor (its
    entries in ``by`` and its level), and the values of the measures."""

    def __init__(self, n_by: int, n_measures: int, n_factors: int):
        self.n_by, self.n_measures, self.n_factors, self.n = n_by, n_measures, n_factors, 0

    def _begin(self) -> None:
        """Codes are those of a chunk: what a task holds is bounded by its rows."""
        self.by_keys: dict = {}
        self.groups: list[dict] = [{} for _ in range(self.n_factors)]
        self.codes, self.values = [[] for _ in range(self.n_factors)], [[] for _ in range(self.n_measures)]

    def add(self, batch: pa.RecordBatch) -> None:
        if not self.n:
            self._begin()
        n, by = batch.num_rows, np.zeros(batch.num_rows, dtype=np.int64)
        keys = [()]
        for c in range(self.n_by):
            d = pc.dictionary_encode(batch.column(c), null_encoding="encode")
            own = d.dictionary.to_pylist()
            by = by * len(own) + d.indices.to_numpy()
            keys = [(*k, x) for k in keys for x in own]
        code = np.array([self.by_keys.setdefault(k, len(self.by_keys)) for k in keys], dtype=np.int64)
        by, n_by = code[by], len(self.by_keys)
        for j in range(self.n_measures):
            col = batch.column(self.n_by + j)
            v = col.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0
            self.values[j].append((v, col.is_null().to_numpy(zero_copy_only=False)))
        for i, groups in enumerate(self.groups):
            d = pc.dictionary_encode(batch.column(self.n_by + self.n_measures + i), null_encoding="encode")
            own = d.dictionary.to_pylist()
            pair = by + d.indices.to_numpy().astype(np.int64) * n_by
            there = np.flatnonzero(np.bincount(pair, minlength=len(own) * n_by))
            found = np.zeros(len(own) * n_by, dtype=np.int32)
            for p in there.tolist():
                found[p] = groups.setdefault((p % n_by, own[p // n_by]), len(groups))
            self.codes[i].append(found[pair])
        self.n += n

    def chunk(self) -> tuple[list, list]:
        """The rows so far, values with their NULLs and codes; the next row begins a new chunk."""
        values = [tuple(np.concatenate(x) for x in zip(*v)) for v in self.values]
        codes = [np.concatenate(c) for c in self.codes]
        self.n = 0
        return values, codes

    def columns(self, factor: int, code: np.ndarray, by_types: list) -> list[pa.Array]:
        """The ``by`` entries, the factor's number and the level of groups."""
        by_of = list(self.by_keys)
        keys = list(self.groups[factor])
        at = np.fromiter((k[0] for k in keys), dtype=np.int64, count=len(keys))[code]
        out = [pa.array([k[c] for k in by_of], type=t).take(pa.array(at)) for c, t in enumerate(by_types)]
        return [*out, pa.array(np.full(len(code), factor, dtype=np.int32)),
                pa.array([k[1] for k in keys], type=pa.string()).take(pa.array(code))]


def _in_chunks(batches, coded: _Coded):
    for batch in batches:
        if batch.num_rows:
            coded.add(batch)
        if coded.n >= CHUNK:
            yield coded.chunk()
    if coded.n:
        yield coded.chunk()


def _measure_order(values: list, points: list[np.ndarray]) -> list[tuple]:
    """Of each measure: the rows in the order of their values, NULLs last,
    the number of rows that have one, their values and their cells."""
    out = []
    for (v, null), p in zip(values, points):
        order = np.lexsort((v, null))
        n = len(v) - int(null.sum())
        sorted_ = v[order]
        cell = _cell(sorted_, p)
        cell[n:] = -1
        out.append((order, n, sorted_, cell))
    return out


def count_cells(n_by: int, n_factors: int, points: list[list[float]]):
    """For ``mapInArrow`` on rows of ``by``, measures and factors: per group and
    cell of a chunk its rows, and sum, least and greatest of their values."""
    def run(batches):
        ps = [np.array(p, dtype=float) for p in points]
        coded, types = _Coded(n_by, len(ps), n_factors), None

        def head(bs):
            nonlocal types
            for b in bs:
                types = types or [b.schema.field(c).type for c in range(n_by)]
                yield b

        for values, codes in _in_chunks(head(batches), coded):
            for j, (order, n, v, cell) in enumerate(_measure_order(values, ps)):
                width = 2 * len(ps[j]) + 2                 # cell -1 first
                for i, g in enumerate(codes):
                    place = g[order].astype(np.int64) * width + (cell + 1)
                    size = len(coded.groups[i]) * width
                    if size > DENSE:
                        ids, place = np.unique(place, return_inverse=True)
                        size = len(ids)
                    rows = np.bincount(place, minlength=size)
                    total = np.bincount(place[:n], weights=v[:n], minlength=size).astype(float)        # of no rows it is of integers
                    lo, hi = np.zeros(size), np.zeros(size)
                    hi[place[:n]] = v[:n]                   # of repeated places the last entry stays
                    lo[place[:n][::-1]] = v[:n][::-1]
                    there = np.flatnonzero(rows)
                    full = ids[there] if len(coded.groups[i]) * width > DENSE else there
                    c = (full % width - 1).astype(np.int32)
                    void = c < 0
                    num = lambda a: pa.array(a[there], mask=void, from_pandas=False)
                    cols = [*coded.columns(i, full // width, types), pa.array(np.full(len(there), j, dtype=np.int32)), pa.array(c),
                            pa.array(rows[there].astype(np.int64)), num(total), num(lo), num(hi)]
                    yield pa.RecordBatch.from_arrays(cols, names=[str(x) for x in range(len(cols))])
    return run


def values_of_cells(n_by: int, n_factors: int, points: list[list[float]], wanted: dict):
    """For ``mapInArrow``: the values of the wanted cells, ``(factor, measure)``
    → ``(by entries, level)`` → cells, with the rows of a chunk that have them."""
    def run(batches):
        ps = [np.array(p, dtype=float) for p in points]
        coded, types = _Coded(n_by, len(ps), n_factors), None

        def head(bs):
            nonlocal types
            for b in bs:
                types = types or [b.schema.field(c).type for c in range(n_by)]
                yield b

        for values, codes in _in_chunks(head(batches), coded):
            by_of = list(coded.by_keys)
            for j, (order, n, v, cell) in enumerate(_measure_order(values, ps)):
                width = 2 * len(ps[j]) + 2
                for i, g in enumerate(codes):
                    cells = wanted.get((i, j))
                    if not cells:
                        continue
                    own = [code * width + c + 1 for (b, level), code in coded.groups[i].items() for c in cells.get((by_of[b], level), ())]
                    place = g[order[:n]].astype(np.int64) * width + (cell[:n] + 1)
                    pick = np.flatnonzero(np.isin(place, np.array(own, dtype=np.int64)))
                    if not len(pick):
                        continue
                    p, x = place[pick], v[pick]
                    by_place = np.argsort(p, kind="stable")            # values are in order within a place
                    p, x = p[by_place], x[by_place]
                    first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | ~((x[1:] == x[:-1]) | (np.isnan(x[1:]) & np.isnan(x[:-1])))])
                    cols = [*coded.columns(i, p[first] // width, types), pa.array(np.full(len(first), j, dtype=np.int32)),
                            pa.array((p[first] % width - 1).astype(np.int32)), pa.array(x[first]),
                            pa.array(np.diff(np.r_[first, len(p)]).astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, names=[str(x) for x in range(len(cols))])
    return run


def factor_statistics(df: DataFrame, by: list[str], factors: list[str], measures: list[str], probs: dict[str, float],
                      per_point: int, least: int = POINTS, broadcast_cells: int = BROADCAST_CELLS) -> DataFrame:
    """One row per ``by``, ``_vi`` (number of the factor), ``level`` and ``_mi``
    (number of the measure): ``_rows`` (NULL values included), ``_n`` (without
    them), ``_min``, ``_max``, ``_tot``, ``_avg`` and a type-7 quantile for each
    entry of ``probs``."""
    rows = df.select(*by, *[F.col(m).cast("double").alias(m) for m in measures], *[F.col(f).cast("string").alias(f) for f in factors])
    points = measure_points(rows, measures, per_point, least)
    keys = [*by, "_vi", "level", "_mi"]
    fields = [*[T.StructField(f.name, f.dataType) for f in rows.select(*by).schema.fields], T.StructField("_vi", T.IntegerType()),
              T.StructField("level", T.StringType()), T.StructField("_mi", T.IntegerType()), T.StructField("_b", T.IntegerType())]
    doubles = lambda *names: [T.StructField(n, T.DoubleType()) for n in names]
    counts = T.StructField("_c", T.LongType())
    made = rows.mapInArrow(count_cells(len(by), len(factors), points), T.StructType([*fields, counts, *doubles("_s", "_lo", "_hi")]))
    cells = stage(made.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c"), F.sum("_s").alias("_s"), F.min("_lo").alias("_lo"),
                                                F.max("_hi").alias("_hi")), "factor-cells")
    # a struct of the keys equals itself with NULL fields too
    key = F.struct(*[F.col(f"`{k}`") for k in keys])
    there = F.col("_b") >= 0
    group = Window.partitionBy("_k")
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    held = F.when(there, F.col("_c")).otherwise(0)
    index = cells.select(key.alias("_k"), "_b", "_c", "_s", "_lo", "_hi", held.alias("_h"))
    index = index.withColumns({"_off": F.coalesce(F.sum("_h").over(before), F.lit(0)), "_n": F.sum("_h").over(group)})
    ranks = {f"_{side}_{i}": end((F.col("_n") - 1) * F.lit(float(p))) for i, p in enumerate(probs.values())
             for side, end in (("l", F.floor), ("r", F.ceil))}
    met = {name: there & (r >= F.col("_off")) & (r < F.col("_off") + F.col("_c")) for name, r in ranks.items()}
    known = lambda r: (F.when((F.col("_lo") == F.col("_hi")) | (r == F.col("_off")), F.col("_lo"))
                       .when(r == F.col("_off") + F.col("_c") - 1, F.col("_hi")))
    open_ = {name: met[name] & known(r).isNull() for name, r in ranks.items()}
    asked = F.struct("_b", *[F.when(open_[name], r - F.col("_off")).alias(name) for name, r in ranks.items()])
    groups = stage(index.groupBy("_k").agg(
        F.sum("_c").alias("_rows"), F.max("_n").alias("_n"), F.min("_lo").alias("_min"), F.max("_hi").alias("_max"), F.sum("_s").alias("_tot"),
        *[F.max(F.when(met[name], known(r))).alias(name) for name, r in ranks.items()],
        F.collect_list(F.when(reduce(lambda a, b: a | b, open_.values()), asked)).alias("_asked")), "factor-groups")      # two for a quantile at most
    wanted = groups.select("_k", F.inline("_asked"))
    n_wanted = wanted.count()
    if n_wanted <= broadcast_cells:
        lists: dict = {}
        for r in wanted.select("_k", "_b").collect():               # bounded by broadcast_cells
            *b, vi, level, mi = r["_k"]
            lists.setdefault((vi, mi), {}).setdefault((tuple(b), level), []).append(r["_b"])
        found = rows.mapInArrow(values_of_cells(len(by), len(factors), points, lists), T.StructType([*fields, *doubles("_v"), counts]))
        found = found.groupBy(key.alias("_k"), "_b", "_v").agg(F.sum("_c").alias("_c"))
    else:
        found = _joined_values(rows, by, factors, measures, points, key, wanted)
    found = stage(found, "cell-values")
    running = Window.partitionBy("_k", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = found.withColumn("_end", F.sum("_c").over(running)).join(wanted.hint("merge"), ["_k", "_b"])
    inside = lambda r: (F.col(r) >= F.col("_end") - F.col("_c")) & (F.col(r) < F.col("_end"))
    ranked = placed.groupBy("_k").agg(*[F.max(F.when(inside(name), F.col("_v"))).alias(f"{name}v") for name in ranks])
    both = groups.join(ranked, "_k", "left")
    out = [F.col(f"_k.`{k}`").alias(k) for k in keys] + ["_rows", "_n", "_min", "_max", "_tot", F.try_divide("_tot", "_n").alias("_avg")]
    for i, (name, p) in enumerate(probs.items()):
        h = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = (F.coalesce(f"_{side}_{i}", f"_{side}_{i}v") for side in "lr")
        out.append((lo + (h - F.floor(h)) * (hi - lo)).alias(name))
    return both.select(*out)


def _joined_values(rows: DataFrame, by: list[str], factors: list[str], measures: list[str], points: list[list[float]], key,
                   wanted: DataFrame) -> DataFrame:
    """``values_of_cells`` by a join, for any number of cells."""
    fstack = ", ".join(f"{i}, `{f}`" for i, f in enumerate(factors))
    mstack = ", ".join(f"{j}, `{m}`, `_b{j}`" for j, m in enumerate(measures))
    long = (rows.withColumns({f"_b{j}": cell_of(F.col(f"`{m}`"), points[j]) for j, m in enumerate(measures)})
            .select(*by, *measures, *[f"_b{j}" for j in range(len(measures))], F.expr(f"stack({len(factors)}, {fstack}) AS (_vi, level)"))
            .select(*by, "_vi", "level", F.expr(f"stack({len(measures)}, {mstack}) AS (_mi, _v, _b)")).where("_b >= 0"))
    counted = long.groupBy(key.alias("_k"), "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    return counted.join(wanted.select("_k", "_b").hint("merge"), ["_k", "_b"], "left_semi")
