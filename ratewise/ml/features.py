"""Feature assembly for MLlib: codes of the model factors (ML1, ML2), one-hot
for linear models, numeric extras, in one ``features`` vector.  Fitted on the
train rows only; applied to any split, and stored with a saved model.

The encoder is an MLlib string indexer over level lists of our own order, so a
level is looked up in a hash table on the executors and no plan holds the
levels:

* ``ordinal``      levels in numeric or text order, codes 0, 1, ...
* ``EnumLimited``  the ``top`` most frequent levels in that order, all others
                   share one code
* ``Eigen``        the level's projection on the first principal component of
                   the factor's one-hot matrix (0, the mean, for other levels)

Levels that the train rows don't have, and NULL, get the code after the last.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import MAX_ENCODED_LEVELS, eigen_codes, ordinal_codes, top_levels
from ..schema import MODEL_FEATURES

ENCODINGS = ("ordinal", "EnumLimited", "Eigen")
#: Stands for a factor without any level: a label no level can be.
_NO_LEVEL = "\u0000"


@dataclass
class FeatureSpace:
    factors: list[str]
    numeric: list[str]
    pipeline: PipelineModel
    encoding: str = "ordinal"
    #: ``Eigen``: the value of each code, per factor.
    values: dict[str, list[float]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return self.factors + self.numeric

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        text = df.withColumns({f: F.col(f).cast("string") for f in self.factors})
        coded = self.pipeline.transform(text)
        if self.values:
            coded = coded.withColumns({
                f"{f}_code": F.coalesce(F.get(F.lit(v).cast("array<double>"), F.col(f"{f}_code").cast("int")), F.lit(0.0))
                for f, v in self.values.items()})
        one_hot = bool(self.factors) and f"{self.factors[0]}_oh" in coded.columns
        if not one_hot:      # plain numbers: trees split codes by their order, whatever the number of levels
            coded = coded.withColumns({f"{f}_code": F.col(f"{f}_code") + F.lit(0.0) for f in self.factors})
        inputs = [f"{f}_oh" if one_hot else f"{f}_code" for f in self.factors] + self.numeric
        made = VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="keep").transform(coded)
        return made.drop(*[f"{f}{s}" for f in self.factors for s in ("_code", "_oh")])

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(os.path.join(path, "pipeline"))
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.factors, self.numeric, self.encoding, json.dumps(self.values))],
                              "factors array<string>, numeric array<string>, encoding string, values string"
                              ).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "space"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeatureSpace":
        row = spark.read.parquet(os.path.join(path, "space")).first()      # one row
        return cls(list(row["factors"]), list(row["numeric"]), PipelineModel.load(os.path.join(path, "pipeline")),
                   row["encoding"], json.loads(row["values"]))


def _level_lists(codes: DataFrame, factors: list[str], order: str) -> dict[str, list[str]]:
    if codes.count() > MAX_ENCODED_LEVELS:
        raise ValueError(f"the encoder is bounded to {MAX_ENCODED_LEVELS} levels; use transform_join for factors with more")
    lists: dict[str, list] = {f: [] for f in factors}
    for r in codes.collect():                      # bounded by MAX_ENCODED_LEVELS (checked above)
        lists[r["variable"]].append((r[order], r["level"]))
    return {f: [level for _, level in sorted(v)] or [_NO_LEVEL] for f, v in lists.items()}


def _indexer(levels: list[list[str]]) -> StringIndexerModel:
    """An indexer over given lists.  ``from_arrays_of_labels`` fills shorter
    lists up with nulls, which would be levels."""
    sc = SparkContext._active_spark_context
    text = sc._jvm.java.lang.String
    lists = sc._jvm.java.lang.reflect.Array.newInstance(sc._gateway.new_array(text, 0).getClass(), len(levels))
    for i, labels in enumerate(levels):
        one = sc._gateway.new_array(text, len(labels))
        for j, label in enumerate(labels):
            one[j] = label
        lists[i] = one
    return StringIndexerModel(sc._jvm.org.apache.spark.ml.feature.StringIndexerModel(f"codes_{uuid.uuid4().hex[:12]}", lists))


def fit_features(train: DataFrame, factors: list[str] | None = None, numeric: list[str] | None = None,
                 one_hot: bool = False, encoding: str = "ordinal", top: int = 10) -> FeatureSpace:
    """``encoding`` is the tuning parameter ``categorical_encoding``."""
    if encoding not in ENCODINGS:
        raise ValueError(f"categorical_encoding is one of {', '.join(ENCODINGS)}")
    factors = factors or MODEL_FEATURES
    if encoding == "EnumLimited":
        kept = top_levels(train, factors, top)
        codes = ordinal_codes(train, factors).join(kept.select("variable", "level"), ["variable", "level"], "left_semi")
    else:
        codes = ordinal_codes(train, factors)
    levels = _level_lists(codes, factors, "code")
    values = {}
    if encoding == "Eigen":
        found = eigen_codes(train, factors)
        values = {f: [found.get(f, {}).get(level, 0.0) for level in levels[f]] for f in factors}
    index = _indexer([levels[f] for f in factors])
    index.setInputCols(factors).setOutputCols([f"{f}_code" for f in factors]).setHandleInvalid("keep")
    stages = [index]
    if one_hot:
        encoder = OneHotEncoder(inputCols=[f"{f}_code" for f in factors], outputCols=[f"{f}_oh" for f in factors],
                                handleInvalid="keep", dropLast=True)
        text = train.select(*[F.col(f).cast("string").alias(f) for f in factors])
        stages.append(encoder.fit(index.transform(text)))     # sizes come from the index, not from a job
    return FeatureSpace(factors, list(numeric or []), PipelineModel(stages), encoding, values)
