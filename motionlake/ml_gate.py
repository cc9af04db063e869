"""The learned hit gate: a random forest on the hit features decides which candidates stay."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The features and the limits of the gate.
FEATURES = ["wrist_speed", "ball_dist", "ball_vel_before", "ball_vel_after", "ball_vel_change", "ball_angle_change", "racket_dist"]
DROP_BELOW, HIGH_ABOVE = 0.4, 0.8


def train(candidates: DataFrame, trees: int = 100, depth: int = 5, seed: int = 42) -> PipelineModel:
    """Fits on the labelled rows (``is_hit`` 0 or 1); missing features are 0."""
    rows = candidates.filter(F.col("is_hit").isNotNull()).fillna(0.0, FEATURES).withColumn("label", F.col("is_hit").cast("double"))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows)


def gate(candidates: DataFrame, model: PipelineModel) -> DataFrame:
    """Drops unlikely candidates and raises sure ones to HIGH."""
    scored = model.transform(candidates.fillna(0.0, FEATURES)).withColumn("p_hit", F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)))
    kept = scored.filter(F.col("p_hit") >= DROP_BELOW).drop("features", "rawPrediction", "probability", "prediction")
    return kept.withColumn("confidence", F.when(F.col("p_hit") > HIGH_ABOVE, "HIGH").otherwise(F.col("confidence")))
