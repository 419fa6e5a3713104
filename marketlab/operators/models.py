"""Model hooks on pyspark.ml: the outcome model, the walk-forward ablation and scoring leans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.functions.mathx import clip, log_loss
from marketlab.operators.scans import pin


def outcome_model(train: DataFrame, features: Sequence[str], label: str = "fwd", limit: float = 0.004):
    """Linear model of the forward return scaled to +-1 at `limit`, standardised inputs."""
    x = train.withColumn("_y", clip(F.col(label) / limit))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_x", withMean=True),
                            LinearRegression(featuresCol="_x", labelCol="_y", predictionCol="pred", regParam=0.01, solver="normal")]).fit(x)


def directional_accuracy(scored: DataFrame, label: str = "fwd", least: float = 0.05) -> DataFrame:
    """Share of right signs among predictions with an opinion."""
    s = scored.where(F.abs("pred") >= least)
    return s.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pred") * F.col(label) > 0).cast("double")).alias("accuracy"))


def model_lean(scored: DataFrame, veto: float = 0.05, gain: float = 1.0) -> DataFrame:
    """Tanh lean of a model score, silent below the veto."""
    return scored.withColumn("lean", F.when(F.abs("pred") < veto, 0.0).otherwise(F.tanh(gain * F.col("pred"))))


def ablation(folds: DataFrame, features: Sequence[str], signal: str, ret: str, n_folds: int) -> DataFrame:
    """Logistic P(up) with and without the signal on expanding folds: accuracy, log loss and deltas.

    `folds` carries fold and role as made by `rules.fold_roles`; one model is fitted per fold and input set.
    """
    x = pin(folds.select("fold", "role", *features, signal, (F.col(ret) > 0).cast("double").alias("_y")))
    out = None
    for k in range(1, n_folds + 1):
        tr, te = x.where(f"fold = {k} AND role = 'train'"), x.where(f"fold = {k} AND role = 'test'")
        classes = tr.agg(F.count_distinct("_y").alias("c"), F.count(F.lit(1)).alias("n")).first()
        if classes["c"] < 2 or te.isEmpty():
            continue
        for tag, cols in (("base", list(features)), ("with", [*features, signal])):
            m = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_x", withMean=True),
                                 LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / classes["n"], maxIter=50)]).fit(tr)
            p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), vector_to_array("probability")[1]))
            r = m.transform(te).select(p.alias("p"), "_y").agg(F.avg(((F.col("p") > 0.5) == (F.col("_y") > 0.5)).cast("double")).alias("acc"),
                                                               F.avg(log_loss(F.col("p"), F.col("_y"))).alias("ll")).withColumn("tag", F.lit(tag))
            out = r if out is None else out.unionByName(r)
    a = [F.avg(F.when(F.col("tag") == t, F.col(c))).alias(f"{t}_{c}") for t in ("base", "with") for c in ("acc", "ll")]
    return out.agg(*a).withColumns({"d_acc": F.col("with_acc") - F.col("base_acc"), "d_ll": F.col("with_ll") - F.col("base_ll")})
