"""Model-facing surface: batch scoring, classifier on patch features, calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchscope.operators.relational import names

# Diagnostics stored behind the model features and withheld from the model.
WITHHELD = ("dbzs", "uh25", "uh03", "maxw", "ctts", "mask")


def model_inputs(features: Sequence[str], withheld: Sequence[str] = WITHHELD) -> list[str]:
    """Features a model sees: everything but the diagnostics."""
    return [f for f in features if f not in withheld]


def score(
    df: DataFrame, predict: Callable[[np.ndarray], np.ndarray], inputs: Sequence[str], keep: Iterable[str], prob: str = "prob"
) -> DataFrame:
    """Batch scoring: ``predict`` maps (rows, pixels, features), or (rows, features) for
    plain numbers, to one probability per row.

    The function is shipped once per task; Arrow batches stream through it.
    """
    keep, inputs = names(keep), list(inputs)
    fields = [df.schema[c] for c in keep] + [T.StructField(prob, T.DoubleType())]
    arrays = isinstance(df.schema[inputs[0]].dataType, T.ArrayType)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if arrays:
                stacked = np.stack([np.stack(frame[c].to_numpy()) for c in inputs], axis=-1) if len(frame) else np.empty((0, 0, len(inputs)))
            else:
                stacked = frame[inputs].to_numpy(dtype="float64")
            result = frame[keep].copy()
            result[prob] = np.asarray(predict(stacked), dtype="float64").reshape(len(frame))
            yield result

    needed = list(dict.fromkeys([*keep, *inputs]))
    return df.select(*needed).mapInPandas(batches, T.StructType(fields))


def fit_classifier(df: DataFrame, features: Sequence[str], label: str = "label", max_iter: int = 20) -> PipelineModel:
    """Logistic regression on patch features, trained by distributed gradient sums on the rows with all features and a label."""
    df = df.dropna(subset=[*features, label])
    assembler = VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="keep")
    model = LogisticRegression(featuresCol="__features", labelCol=label, maxIter=max_iter, regParam=0.01)
    return Pipeline(stages=[assembler, model]).fit(df.withColumn(label, F.col(label).cast("double")))


def classify(model: PipelineModel, df: DataFrame, prob: str = "prob") -> DataFrame:
    """Adds the probability; NULL where a feature is missing."""
    scored = model.transform(df)
    p = vector_to_array("probability")[1]
    return scored.withColumn(prob, F.when(~F.isnan(p), p)).drop("__features", "rawPrediction", "probability", "prediction")


def calibrate_fit(df: DataFrame, prob: str = "prob", label: str = "label") -> IsotonicRegressionModel:
    """Isotonic fit of label on probability.

    Equal probabilities are pooled into weighted rows first; that is exact, and the fit
    then only meets distinct probabilities.
    """
    pooled = df.groupBy(F.col(prob).cast("double").alias("__p")).agg(
        F.avg(F.col(label).cast("double")).alias("__y"), F.count(F.lit(1)).cast("double").alias("__w")
    ).filter("__p IS NOT NULL")
    return IsotonicRegression(featuresCol="__p", labelCol="__y", weightCol="__w").fit(pooled)


def calibrate(df: DataFrame, model: IsotonicRegressionModel, prob: str = "prob", out: str = "calibrated") -> DataFrame:
    """Apply the calibration; clamped outside the fitted range, linear between its knots."""
    staged = df.withColumn("__p", F.col(prob).cast("double"))
    model = model.copy().setFeaturesCol("__p").setPredictionCol(out)
    return model.transform(staged).drop("__p")
