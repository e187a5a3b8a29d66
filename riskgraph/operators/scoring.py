"""Boosted trees, isotonic calibration, ablation (MLlib)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_trees(train: DataFrame, numeric: list[str], categorical: list[str], trees: int = 20, depth: int = 5, seed: int = 7) -> PipelineModel:
    """Missing numbers are -999; unseen categories get an index of their own."""
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in categorical]
    stages.append(VectorAssembler(inputCols=[*numeric, *[f"{c}_index" for c in categorical]], outputCol="features", handleInvalid="keep"))
    stages.append(GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed, maxBins=64, leafCol="leaf"))
    return Pipeline(stages=stages).fit(train.fillna(-999, numeric))


def predict(model: PipelineModel, df: DataFrame, numeric: list[str]) -> DataFrame:
    return model.transform(df.fillna(-999, numeric)).withColumn("raw", vector_to_array("probability")[1])


def importances(model: PipelineModel, names: list[str], n: int) -> list[tuple[str, float]]:
    """The n features of largest gain share."""
    return sorted(zip(names, model.stages[-1].featureImportances.toArray(), strict=True), key=lambda x: (-x[1], x[0]))[:n]


def calibrate(val: DataFrame, df: DataFrame) -> DataFrame:
    """Adds score: isotonic in raw, fitted on the validation split alone."""
    if val.filter("split <> 'val'").limit(1).count():
        raise ValueError("calibration must be fitted on the validation split alone")
    model = IsotonicRegression(labelCol="label", featuresCol="raw", predictionCol="calibrated").fit(val)
    out = model.transform(df).withColumn("score", F.greatest(F.least("calibrated", F.lit(1.0)), F.lit(0.0)))
    return out
