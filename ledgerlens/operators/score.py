"""Batch scoring with fitted Spark ML models, and evaluation on a hold-out."""

from __future__ import annotations

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.numbers import rounded
from ledgerlens.functions.text import quoted
from ledgerlens.operators.evaluate import classification_metrics, regression_metrics
from ledgerlens.operators.filters import feature_columns
from ledgerlens.plans.catalog import local_table


def align_features(df: DataFrame, expected: list[str] | None = None, count: int | None = None, target: str | None = None) -> list[str]:
    """Columns to score with: by name, else the numeric columns when their number fits."""
    if expected and all(c in df.columns for c in expected):
        return list(expected)
    numeric = feature_columns(df, target)
    wanted = len(expected) if expected else count
    if wanted is not None and len(numeric) == wanted:
        return numeric
    if expected:
        missing = [c for c in expected if c not in df.columns]
        if missing and len(missing) < len(expected):
            raise ValueError(f"Missing features: {', '.join(missing)}")
        raise ValueError(f"Feature mismatch: model expects {len(expected)} features, data has {len(numeric)}")
    if wanted is not None:
        raise ValueError(f"Feature mismatch: model expects {wanted} features, data has {len(numeric)}")
    return numeric


def with_features(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep").transform(df)


def batch_score(model: Model, df: DataFrame, columns: list[str]) -> DataFrame:
    """Predictions and, for classifiers, class probabilities and their maximum."""
    ready = df if isinstance(model, PipelineModel) else with_features(df, columns)
    scored = model.transform(ready)
    out = scored.drop("features", "rawPrediction")
    if "probability" in scored.columns:
        out = out.withColumn("probability", vector_to_array("probability")).withColumn("confidence", F.array_max("probability"))
    return out


def score_summary(scored: DataFrame) -> DataFrame:
    """Rows and mean confidence of a scored table."""
    sure = F.avg("confidence") if "confidence" in scored.columns else F.lit(None).cast("double")
    return scored.agg(F.count("prediction").alias("n_predictions"), rounded(sure, 4).alias("mean_confidence"))


def feature_importances(model: Model, columns: list[str], spark) -> DataFrame:
    """(feature, importance), largest first."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray().tolist()
    else:
        values = [abs(v) for v in model.coefficients.toArray().tolist()]
    return local_table(spark, list(zip(columns, values)), "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def in_holdout(key: Column, share: float = 0.2) -> Column:
    """Does a row belong to the hold-out?  Decided by a digest of its key, so every run agrees."""
    bucket = F.conv(F.substring(F.md5(key.cast("string")), 1, 6), 16, 10).cast("bigint")
    return bucket % 1000 < int(share * 1000)


def evaluate_on_dataset(estimator, df: DataFrame, columns: list[str], target: str, key: str, share: float = 0.2, classification: bool = False) -> DataFrame:
    """Fit on the rows outside the hold-out and measure on those inside."""
    rows = with_features(df, columns).withColumn("_held", in_holdout(quoted(key), share))
    model = estimator.fit(rows.where(~F.col("_held")))
    scored = model.transform(rows.where("_held"))
    if classification:
        return classification_metrics(scored.withColumn("_p", F.col("prediction").cast(df.schema[target].dataType)), target, "_p")
    return regression_metrics(scored, target, "prediction")
