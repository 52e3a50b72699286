"""Classifiers on feature tables: median imputation, robust scaling, and a model, as one pyspark.ml pipeline."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, RobustScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pipeline(features: list[str], label: str, model: str = "logistic", seed: int = 7) -> Pipeline:
    filled = [f"{f}__filled" for f in features]
    last = {"logistic": LogisticRegression(labelCol="__label", featuresCol="__scaled", maxIter=50, regParam=0.01), "forest": RandomForestClassifier(labelCol="__label", featuresCol="__scaled", numTrees=40, maxDepth=6, seed=seed)}[model]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__features"), RobustScaler(inputCol="__features", outputCol="__scaled", withCentering=True),
        StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc"), last,
    ])


def fit(rows: DataFrame, features: list[str], label: str, model: str = "logistic") -> PipelineModel:
    return pipeline(features, label, model).fit(rows.where(F.col(label).isNotNull()))


def predictions(model: PipelineModel, rows: DataFrame, label: str) -> DataFrame:
    """Rows with ``truth`` and ``predicted`` as texts."""
    names = F.array(*map(F.lit, next(s for s in model.stages if hasattr(s, "labels")).labels))
    out = model.transform(rows)
    return out.select(*rows.columns, F.col(label).cast("string").alias("truth"), F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"))
