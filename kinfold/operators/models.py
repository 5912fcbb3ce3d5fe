"""Boosted-tree pair models under grouped cross-validation with a locked holdout."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import N_FOLDS


#: Rounds stop once the error on the left-out fold no longer falls by this share.
STOP_TOL = 0.001


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values as -1 with an indicator beside them: Spark's trees take no nulls."""
    new = {c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in columns}
    return df.withColumns({f"{c}_isnull": F.col(c).isNull().cast("double") for c in columns}).withColumns(new)


def _pipeline(columns: list[str], seed: int, rounds: int, depth: int, rate: float) -> Pipeline:
    inputs = columns + [f"{c}_isnull" for c in columns]
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=inputs, outputCol="_features"),
            GBTClassifier(
                featuresCol="_features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, predictionCol="_pred",
                validationIndicatorCol="_valid", validationTol=STOP_TOL,
            )
            .setProbabilityCol("_prob")
            .setRawPredictionCol("_raw"),
        ]
    )


def fit_folds(df: DataFrame, columns: list[str], seeds: tuple[int, ...] = (42,), rounds: int = 20, depth: int = 5, rate: float = 0.1) -> list[tuple[int, PipelineModel]]:
    """(fold, model) for each fold and seed, fitted on the other folds; the holdout (fold -1) is never seen.

    ``rounds`` is the most: the left-out fold says when to stop, as the model is only scored on it afterwards.
    """
    x = filled(df, columns).where("fold >= 0").persist()
    try:
        return [(k, _pipeline(columns, s, rounds, depth, rate).fit(x.withColumn("_valid", F.col("fold") == k))) for s in seeds for k in range(N_FOLDS)]
    finally:
        x.unpersist()


def score(df: DataFrame, columns: list[str], models: list[PipelineModel], out: str = "p") -> DataFrame:
    """Mean probability over all models."""
    x = filled(df, columns)
    for i, m in enumerate(models):
        x = m.transform(x).withColumn(f"_p{i}", vector_to_array("_prob")[1]).drop("_features", "_raw", "_prob", "_pred")
    mean = reduce(lambda a, b: a + b, [F.col(f"_p{i}") for i in range(len(models))]) / len(models)
    return x.withColumn(out, mean).select(*df.columns, out)


def out_of_fold(df: DataFrame, columns: list[str], models: list[tuple[int, PipelineModel]], out: str = "p") -> DataFrame:
    """Each row scored by the models that didn't see its fold; holdout rows by all of them."""
    parts = [score(df.where(F.col("fold") == k), columns, [m for f, m in models if f == k], out) for k in range(N_FOLDS)]
    parts.append(score(df.where("fold < 0"), columns, [m for _, m in models], out))
    return reduce(DataFrame.unionByName, parts)


def importance(df: DataFrame, columns: list[str], models: list[tuple[int, PipelineModel]]) -> DataFrame:
    """Feature importances in percent, summed over the models; one row per feature."""
    names = columns + [f"{c}_isnull" for c in columns]
    total = [0.0] * len(names)
    for _, m in models:
        for i, v in enumerate(m.stages[-1].featureImportances.toArray()):
            total[i] += float(v)
    whole = sum(total) or 1.0
    return df.sparkSession.createDataFrame([(n, 100 * v / whole) for n, v in zip(names, total, strict=True)], "feature string, gain_pct double")


def save(models: list[tuple[int, PipelineModel]], path: str) -> None:
    for i, (k, m) in enumerate(models):
        m.write().overwrite().save(f"{path}/model-{i}-fold-{k}")


def load(path: str, n: int, seeds: int = 1) -> list[tuple[int, PipelineModel]]:
    return [(i % n, PipelineModel.load(f"{path}/model-{i}-fold-{i % n}")) for i in range(n * seeds)]
