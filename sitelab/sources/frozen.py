"""Frozen parameters: calibrators, thresholds and linear weights as written tables.

What a fit found is written once to a folder and read back by whoever scores later, in
another session if need be. Every table is keyed by ``model_id``:

* ``calibrators`` (model_id, method, slope, intercept, on_logit), one row per model,
* ``steps`` (model_id, x, y), the boundaries of the isotonic ones,
* ``thresholds`` (model_id, target_fp_per_million, exceed_score),
* ``weights`` (model_id, feature, weight), the intercept under ``INTERCEPT``.

A folder is written once; freezing what is there already is an error, so that scores
cannot change behind those who use it. Rows of a model without a calibrator get NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelab.functions.scoring import logit, sigmoid
from sitelab.operators.calibrate import METHODS, Isotonic, Platt, clipped

INTERCEPT = "(intercept)"


def freeze_calibrators(folder: str, chosen: DataFrame, platt: Platt, isotonic: Isotonic) -> None:
    """Write the chosen method (model_id, method) of each model with its parameters; fits are by model_id."""
    named = chosen.select("model_id", "method")
    if (unknown := named.filter(~F.col("method").isin(*METHODS)).first()) is not None:
        raise ValueError(f"unknown method: {unknown.asDict()}")
    if (twice := named.groupBy("model_id").count().filter("count > 1").first()) is not None:
        raise ValueError(f"more than one method for {twice['model_id']}")
    fits = platt.fits.withColumn("on_logit", F.lit(platt.on_logit)).withColumn("method", F.lit("platt"))
    named.join(fits, ["model_id", "method"], "left").write.parquet(f"{folder}/calibrators")
    stepped = named.filter("method = 'isotonic'").join(isotonic.points, "model_id")
    stepped.select("model_id", "x", "y").write.parquet(f"{folder}/steps")


def freeze_thresholds(folder: str, thresholds: DataFrame) -> None:
    thresholds.select("model_id", "target_fp_per_million", "exceed_score").write.parquet(f"{folder}/thresholds")


def freeze_weights(spark: SparkSession, folder: str, model_id: str, features: Sequence[str], weights: Sequence[float], intercept: float) -> None:
    """Write a linear model: one row per feature, and its intercept. Models of one folder are added to each other."""
    if len(features) != len(weights) or len(set(features)) != len(features) or INTERCEPT in features:
        raise ValueError("features must be distinct and have a weight each")
    rows = [(model_id, f, float(w)) for f, w in zip([*features, INTERCEPT], [*weights, intercept], strict=True)]
    path = f"{folder}/weights"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        if not spark.read.parquet(path).filter(F.col("model_id") == model_id).isEmpty():
            raise ValueError(f"weights of {model_id} are frozen already")
    spark.createDataFrame(rows, "model_id string, feature string, weight double").write.mode("append").parquet(path)


@dataclass(frozen=True)
class Frozen:
    """Parameters read back from a folder."""

    spark: SparkSession
    folder: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def calibrated(self, df: DataFrame, score: str = "score", name: str = "probability") -> DataFrame:
        """Every row by its model's frozen method: a closed form, or an as-of join on (model_id, score)."""
        kinds = self._table("calibrators").select(
            "model_id", *[F.col(c).alias(f"_{c}") for c in ("method", "slope", "intercept", "on_logit")]
        )
        rows = df.join(kinds, "model_id", "left")
        x = F.when(F.col("_on_logit"), logit(score)).otherwise(F.col(score))
        closed = F.when(F.col("_method") == "none", clipped(score)).when(
            F.col("_method") == "platt", sigmoid(x * F.col("_slope") + F.col("_intercept"))
        )
        kept = [c for c in df.columns if c != name]
        stepped = F.coalesce(F.col("_method") == "isotonic", F.lit(False))
        direct = rows.filter(~stepped).select(*kept, closed.alias(name))
        steps = Isotonic(self._table("steps"), ("model_id",))
        joined = steps.apply(rows.filter(stepped).select(*kept, clipped(score).alias("_clipped")), "_clipped", name)
        return direct.unionByName(joined.select(*kept, name))

    def called(self, df: DataFrame, target: int, score: str = "probability", name: str = "called") -> DataFrame:
        """Whether a row exceeds its model's frozen threshold; no limit calls every row, no threshold gives NULL."""
        limits = self._table("thresholds").filter(F.col("target_fp_per_million") == target)
        rows = df.join(limits.select("model_id", F.col("exceed_score").alias("_limit"), F.lit(True).alias("_known")), "model_id", "left")
        over = F.when(F.col("_known"), F.coalesce(F.col(score) > F.col("_limit"), F.lit(True)))
        return rows.withColumn(name, over).select(*[c for c in df.columns if c != name], name)

    def linear(self, df: DataFrame, model_id: str, features: dict[str, Column], name: str = "score") -> DataFrame:
        """Scores of one linear model; ``features`` gives a number for each feature, a missing one is an error.

        The weights of one model are as many as it has features.
        """
        found = {r["feature"]: r["weight"] for r in self._table("weights").filter(F.col("model_id") == model_id).collect()}
        if set(found) - {INTERCEPT} != set(features):
            raise ValueError(f"{model_id} has other features: {sorted(set(found) ^ {*features, INTERCEPT})[:5]}")
        total = F.lit(found[INTERCEPT])
        for feature, value in features.items():
            total = total + value * F.lit(found[feature])
        return df.withColumn(name, total)

    def linear_long(self, features: DataFrame, key: str, name: str = "score") -> DataFrame:
        """(key, model_id, score) of all frozen models from features in long form (key, feature, value).

        A feature that a row lacks counts as 0; a row without any feature of a model has no score of it.
        """
        weights = self._table("weights")
        base = weights.filter(F.col("feature") == INTERCEPT).select("model_id", F.col("weight").alias("_b"))
        summed = features.join(weights, "feature").groupBy(key, "model_id").agg(F.sum(F.col("value") * F.col("weight")).alias("_s"))
        return summed.join(base, "model_id").select(key, "model_id", (F.col("_s") + F.col("_b")).alias(name))
