"""Feature preparation as a ``pyspark.ml`` Estimator and Model.

``fit`` learns category codes (1..k by sorted value, 0 for unknown or missing) and exact medians.
``transform`` fills, encodes and derives. The vocabulary is a stored table that the planner joins by its
size; a saved model holds it in its own folder.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicegate import contract
from sluicegate.operators.ordered import exact_quantiles
from sluicegate.session import settle

VOCABULARY_FOLDER = "vocabulary"
VOCABULARY = T.StructType(
    [T.StructField("column_name", T.StringType()), T.StructField("category", T.StringType()), T.StructField("code", T.IntegerType())]
)


def fit_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, category, code): distinct values numbered from 1 in their own sort order."""
    present = [c for c in columns if c in df.columns]
    cells = []
    for c in present:
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        rank = F.col(c).cast("double") if numeric else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(c).alias("column_name"), rank.alias("rank"), F.col(c).cast("string").alias("category")))
    values = df.select(F.inline(F.array(*cells))).where(F.col("category").isNotNull()).distinct()
    # Ranges of values are numbered where they lie, and moved on by the counts of the ranges before them.
    ranged = values.repartitionByRange("column_name", "rank", "category").withColumn("part", F.spark_partition_id())
    stored = settle(ranged)
    ahead = Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        stored.groupBy("column_name", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("column_name", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("column_name", "part").orderBy("rank", "category")
    numbered = stored.withColumn("nth", F.row_number().over(inside)).join(firsts, ["column_name", "part"])
    return numbered.select("column_name", "category", (F.col("before") + F.col("nth")).cast("int").alias("code"))


def fit_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, median): exact, 0 for a column without values."""
    present = [c for c in columns if c in df.columns]
    converted = df.select(*[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in present])
    found = exact_quantiles(converted, present, [0.5]).select(F.col("feature").alias("column_name"), F.col("q_0").alias("median"))
    names = df.sparkSession.createDataFrame([(c,) for c in present], "column_name string")
    return names.join(found, "column_name", "left").select("column_name", F.coalesce("median", F.lit(0.0)).alias("median"))


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Numeric conversion and median fill; a column the table lacks is added as its median."""
    filled = {}
    for c, median in medians.items():
        if c in df.columns:
            filled[c] = F.coalesce(F.expr(f"try_cast(`{c}` AS double)"), F.lit(float(median)))
        else:
            filled[c] = F.lit(float(median))
    return df.withColumns(filled)


def encode(df: DataFrame, vocabulary: DataFrame, columns: list[str]) -> DataFrame:
    """Replace categories by their codes, 0 where unknown; an absent column becomes 0."""
    out = df
    for c in columns:
        if c not in df.columns:
            out = out.withColumn(c, F.lit(0))
            continue
        codes = vocabulary.where(F.col("column_name") == c).select(
            F.col("category").alias(f"__category_{c}"), F.col("code").alias(f"__code_{c}")
        )
        joined = out.join(codes, F.col(c).cast("string") == F.col(f"__category_{c}"), "left")
        out = joined.withColumn(c, F.coalesce(f"__code_{c}", F.lit(0))).drop(f"__category_{c}", f"__code_{c}")
    return out


def derive(df: DataFrame) -> DataFrame:
    """Price difference and ratio to the competitor."""
    return df.withColumns(
        {
            "price_diff": F.col("price") - F.col("competitor_price"),
            "price_ratio": F.col("price") / (F.col("competitor_price") + F.lit(contract.RATIO_EPSILON)),
        }
    )


class _FeatureParams(Params):
    categorical = Param(Params._dummy(), "categorical", "category columns", TypeConverters.toListString)
    numeric = Param(Params._dummy(), "numeric", "numeric columns", TypeConverters.toListString)
    target = Param(Params._dummy(), "target", "target column", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(
            categorical=contract.CATEGORICAL_FEATURES, numeric=contract.NUMERIC_FEATURES, target=contract.TARGET
        )

    @property
    def feature_names(self) -> list[str]:
        numeric = self.getOrDefault(self.numeric)
        derived = contract.DERIVED_FEATURES if {"price", "competitor_price"} <= set(numeric) else []
        return [*self.getOrDefault(self.categorical), *numeric, *derived]


class DemandFeatures(Estimator, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns codes and medians from training rows."""

    def __init__(self, categorical: list[str] | None = None, numeric: list[str] | None = None, target: str | None = None):
        super().__init__()
        given = {"categorical": categorical, "numeric": numeric, "target": target}
        self._set(**{k: v for k, v in given.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> DemandFeaturesModel:
        vocabulary = settle(fit_categories(dataset, self.getOrDefault(self.categorical)).select(*VOCABULARY.names))
        medians = fit_medians(dataset, self.getOrDefault(self.numeric)).collect()
        model = DemandFeaturesModel()
        model._set(
            categorical=self.getOrDefault(self.categorical),
            numeric=self.getOrDefault(self.numeric),
            target=self.getOrDefault(self.target),
            medians=json.dumps({r["column_name"]: r["median"] for r in medians}),
            vocabularyPath=stored_path(vocabulary),
        )
        return model


def stored_path(df: DataFrame) -> str:
    return df.inputFiles()[0].rsplit("/", 1)[0]


class _FeatureWriter(DefaultParamsWriter):
    """Saves the parameters, and the vocabulary in the model's own folder."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.vocabulary_table(self.sparkSession).write.parquet(f"{path}/{VOCABULARY_FOLDER}")


class _FeatureReader(DefaultParamsReader):
    def load(self, path: str) -> DemandFeaturesModel:
        model = super().load(path)
        model._set(vocabularyPath=f"{path}/{VOCABULARY_FOLDER}")
        return model


class DemandFeaturesModel(Model, _FeatureParams, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Applies learned codes and medians. Without having been fitted it has neither, so it raises."""

    medians = Param(Params._dummy(), "medians", "JSON: column to median", TypeConverters.toString)
    vocabularyPath = Param(Params._dummy(), "vocabularyPath", "folder of the vocabulary", TypeConverters.toString)

    def vocabulary_table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(VOCABULARY).parquet(self.getOrDefault(self.vocabularyPath))

    def write(self) -> _FeatureWriter:
        return _FeatureWriter(self)

    @classmethod
    def read(cls) -> _FeatureReader:
        return _FeatureReader(cls)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if not self.isSet(self.medians):
            raise RuntimeError("the feature model has not been fitted")
        medians = json.loads(self.getOrDefault(self.medians))
        fills = {c: medians.get(c, 0.0) for c in self.getOrDefault(self.numeric)}
        vocabulary = self.vocabulary_table(dataset.sparkSession)
        out = encode(impute(dataset, fills), vocabulary, self.getOrDefault(self.categorical))
        if set(contract.DERIVED_FEATURES) <= set(self.feature_names):
            out = derive(out)
        target = self.getOrDefault(self.target)
        if target in dataset.columns:
            out = out.withColumn(target, F.coalesce(F.expr(f"try_cast(`{target}` AS double)"), F.lit(0.0)))
        return out
