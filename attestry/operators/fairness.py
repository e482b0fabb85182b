"""Group fairness: parity, odds, epochs, running rates with a latch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parity(df: DataFrame, pred: str, group: str, *by: str) -> DataFrame:
    """Largest less smallest mean prediction of the groups, for each ``by``; null with fewer than two groups."""
    rates = df.groupBy(*by, group).agg(F.avg(F.col(pred).cast("double")).alias("rate"))
    gap = F.when(F.count("*") >= 2, F.max("rate") - F.min("rate"))
    return rates.groupBy(*by).agg(F.count("*").alias("n_groups"), F.round(gap, 9).alias("disparity"))


def group_rates(df: DataFrame, pred: str, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count_if(F.col(pred) == 1).alias("positives"), F.count("*").alias("total"))


def equalized_odds(df: DataFrame, pred: str, truth: str, group: str) -> DataFrame:
    """Gaps of the true and of the false positive rate."""
    n = lambda p, t: F.count_if((F.col(pred) == p) & (F.col(truth) == t))
    g = df.groupBy(group).agg((n(1, 1) / (n(1, 1) + n(0, 1) + 1e-9)).alias("tpr"), (n(1, 0) / (n(1, 0) + n(0, 0) + 1e-9)).alias("fpr"))
    return g.agg(F.round(F.max("tpr") - F.min("tpr"), 6).alias("tpr_gap"), F.round(F.max("fpr") - F.min("fpr"), 6).alias("fpr_gap"))


def gate(df: DataFrame, epoch: str, pred: str, group: str, threshold: float = 0.1) -> DataFrame:
    """The log: disparity and status for each epoch; ``skipped`` where there is nothing to compare."""
    p = parity(df, pred, group, epoch)
    return p.select(epoch, "disparity", F.lit(threshold).alias("threshold"), F.when(F.col("disparity").isNull(), "skipped").when(F.col("disparity") > threshold, "failed").otherwise("passed").alias("status"))


def assert_passed(log: DataFrame) -> None:
    """Raise if an epoch failed: the gate as a driver's action."""
    if failed := log.where("status = 'failed'").limit(1).collect():
        raise RuntimeError(f"fairness gate: disparity {failed[0]['disparity']} over {failed[0]['threshold']}")


def running(df: DataFrame, batch: str, pred: str, group: str, threshold: float = 0.1) -> DataFrame:
    """Rates accumulated over batches, and a latch that stays once they part too far.

    Rows shrink to one per batch and group first, so the windows run over that small table.
    """
    cells = df.groupBy(batch, group).agg(F.count_if(F.col(pred) == 1).alias("pos"), F.count("*").alias("n"))
    batches, groups = cells.select(batch).distinct(), cells.select(group).distinct()
    full = batches.crossJoin(F.broadcast(groups)).join(cells, [batch, group], "left").fillna(0, ["pos", "n"])
    so_far = Window.partitionBy(group).orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)
    cum = full.select(batch, group, F.sum("pos").over(so_far).alias("pos"), F.sum("n").over(so_far).alias("n")).where("n > 0")
    rate = F.col("pos") / F.col("n")
    g = cum.groupBy(batch).agg(F.when(F.count("*") >= 2, F.max(rate) - F.min(rate)).otherwise(0.0).alias("disparity"))
    first = g.agg(F.min(F.when(F.col("disparity") > threshold, F.col(batch))).alias("__first"))
    return g.crossJoin(F.broadcast(first)).select(batch, F.round("disparity", 9).alias("disparity"), F.coalesce(F.col(batch) >= F.col("__first"), F.lit(False)).alias("blocked"))


def accuracy_by_class(df: DataFrame, pred: str, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.round(F.avg((F.col(pred) == F.col(label)).cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))
