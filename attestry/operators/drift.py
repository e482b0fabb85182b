"""Drift: windows of samples against a baseline, batches of predictions, privacy budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import entropy, kl, softmax, top_mass


def exploded(df: DataFrame, seq: str, vector: str) -> DataFrame:
    return df.select(F.col(seq).alias("seq"), F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def kl_drift(df: DataFrame, seq: str, vector: str, batch: int = 50, baseline_batches: int = 2, window: int = 100, threshold: float = 0.5) -> DataFrame:
    """``(batch, kl, drift)``: mean divergence over the dimensions of the last ``window`` samples at each batch's
    end from the first batches, from when the window is full.

    ``seq`` numbers the samples from 0 without gaps. A batch's window is made of whole batches, so moments of
    (batch, dimension) cells - pre-aggregated before any shuffle - are all that the windows see.
    """
    if window % batch:
        raise ValueError("the window is to be a multiple of the batch")
    cells = exploded(df, seq, vector).groupBy(F.floor(F.col("seq") / batch).alias("batch"), "dim").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    early = cells.where(F.col("batch") < baseline_batches).groupBy("dim").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("at"))
    # Moments are taken about the baseline's mean, so that a large mean cancels nothing.
    off = F.col("m") - F.col("at")
    cells = cells.join(early, "dim").select("batch", "dim", "n", "at", (F.col("n") * off).alias("s"), (F.col("n") * (F.col("v") + off * off)).alias("q"))
    variance = lambda n, s, q: F.greatest((q - s * s / n) / (n - 1), F.lit(1e-8))
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    base = cells.where(F.col("batch") < baseline_batches).groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).select("dim", "at", (F.col("at") + s / n).alias("m0"), variance(n, s, q).alias("v0"))
    w = Window.partitionBy("dim").orderBy("batch").rowsBetween(1 - window // batch, 0)
    cur = cells.select("batch", "dim", F.sum("n").over(w).alias("n"), F.sum("s").over(w).alias("s"), F.sum("q").over(w).alias("q")).where((F.col("n") >= window) & (F.col("batch") >= baseline_batches))
    joined = cur.join(base, "dim").select("batch", "m0", "v0", (F.col("at") + s / n).alias("m"), variance(n, s, q).alias("v"))
    g = joined.groupBy("batch").agg(F.avg(kl(F.col("m0"), F.col("v0"), F.col("m"), F.col("v"))).alias("kl"))
    return g.select("batch", F.round("kl", 6).alias("kl"), (F.col("kl") > threshold).alias("drift"))


def prediction_batches(df: DataFrame, seq: str, logits: str, batch: int = 50, max_entropy: float = 4.7, human_below: float = 0.5) -> DataFrame:
    """Per batch: entropy and top-3 mass of the mean softmax, requests for a human, drift flag."""
    p = df.select(F.floor(F.col(seq) / batch).alias("batch"), softmax(F.col(logits)).alias("p"))
    human = p.groupBy("batch").agg(F.count_if(F.array_max("p") < human_below).alias("n_human"), F.count("*").alias("n"))
    mean = p.select("batch", F.posexplode("p").alias("dim", "x")).groupBy("batch", "dim").agg(F.avg("x").alias("x")).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("m"))
    m = F.transform("m", lambda e: e["x"])
    out = mean.select("batch", entropy(m).alias("e"), top_mass(m).alias("t")).join(human, "batch")
    return out.select("batch", F.round("e", 6).alias("entropy"), F.round("t", 6).alias("top3"), "n_human", "n", (F.col("e") > max_entropy).alias("drift"))


def first_drift(batches: DataFrame) -> DataFrame:
    return batches.agg(F.min(F.when(F.col("drift"), F.col("batch"))).alias("first_drift"))


def before_after(batches: DataFrame, value: str, split: int = 14) -> DataFrame:
    return batches.agg(F.round(F.avg(F.when(F.col("batch") < split, F.col(value))), 6).alias("before"), F.round(F.avg(F.when(F.col("batch") >= split, F.col(value))), 6).alias("after"))


def budget(log: DataFrame, run: str, step: str, epsilon: str, most: float | None) -> DataFrame:
    """Per run the running maximum of a privacy budget, and whether it is spent; without a limit never."""
    w = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    over = F.lit(False) if most is None else F.col("spent") > most
    return log.select(run, step, F.max(epsilon).over(w).alias("spent")).withColumn("over", over)
