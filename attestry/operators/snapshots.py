"""Run snapshots and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("fairness", "fairness_failed", "epsilon", "accuracy", "drift")
#: metric -> (sign of the change that is worse, tolerated change); compared strictly.
RULES = {"fairness": (1, 0.02), "fairness_failed": (1, 0.0), "epsilon": (1, 5.0), "accuracy": (-1, 0.02), "drift": (1, 0.0)}


def unpivot(df: DataFrame, *keys: str) -> DataFrame:
    """Long form ``(metric, value)`` of the metrics that a snapshot has; booleans are 0 and 1."""
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS if m in df.columns))
    return df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.metric", "c.value")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(metric, before, after, delta, regressed)`` for metrics known on both sides."""
    b, a = unpivot(before).withColumnRenamed("value", "before"), unpivot(after).withColumnRenamed("value", "after")
    j = b.join(a, "metric").where("before is not null and after is not null").withColumn("delta", F.col("after") - F.col("before"))
    worse = F.lit(False)
    for m, (sign, tolerance) in RULES.items():
        worse = worse | (F.col("metric") == m) & (sign * F.col("delta") > tolerance)
    return j.select("metric", "before", "after", F.round("delta", 9).alias("delta"), worse.alias("regressed"))


def assert_no_regression(diff: DataFrame) -> None:
    bad = [r.metric for r in diff.where("regressed").select("metric").collect()]  # at most one row a metric
    if bad:
        raise RuntimeError("regressed: " + ", ".join(sorted(bad)))


def coverage_scores(snapshot: DataFrame) -> DataFrame:
    """Radar scores in 0..1 from a snapshot's metrics."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return snapshot.select(clamp(1 - F.col("fairness") / 0.2).alias("fairness_score"), clamp(1 - F.col("epsilon") / 10).alias("privacy_score"), clamp(F.col("accuracy").cast("double")).alias("accuracy_score"), F.when(F.col("drift").cast("boolean"), 0.0).otherwise(1.0).alias("stability_score"))
