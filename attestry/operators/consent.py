"""Consent per subject and purpose, and class profiles of gated data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def access_log(reads: DataFrame, registry: DataFrame, purpose: str | None = None) -> DataFrame:
    """``reads`` with ``status`` and ``reason``. ``registry(subject_id, consent, purposes)``, subjects unique.

    ``purpose`` is a literal, or null to use the reads' own column. An unknown subject has not consented. The
    registry is joined as a table of its own size: Spark broadcasts it if it is small.
    """
    want = F.lit(purpose) if purpose else F.col("purpose")
    r = registry.select(F.col("subject_id").alias("__s"), F.coalesce("consent", F.lit(False)).alias("__c"), F.col("purposes").alias("__p"))
    t = reads.join(r, F.col("subject_id") == F.col("__s"), "left")
    yes = F.coalesce("__c", F.lit(False))
    listed = F.coalesce(F.array_contains("__p", want), F.lit(False))
    reason = F.when(~yes, "consent_withdrawn").when(~listed, "purpose_not_listed").otherwise("consent_granted")
    return t.withColumns({"status": F.when(yes & listed, "granted").otherwise("denied"), "reason": reason}).drop("__s", "__c", "__p")


def granted(reads: DataFrame, registry: DataFrame, purpose: str) -> DataFrame:
    ok = registry.where(F.col("consent") & F.array_contains("purposes", purpose)).select("subject_id")
    return reads.join(ok, "subject_id", "left_semi")


def denied(reads: DataFrame, registry: DataFrame, purpose: str) -> DataFrame:
    ok = registry.where(F.col("consent") & F.array_contains("purposes", purpose)).select("subject_id")
    return reads.join(ok, "subject_id", "left_anti")


def summary(log: DataFrame) -> DataFrame:
    return log.agg(F.count_if(F.col("status") == "granted").alias("granted"), F.count_if(F.col("status") == "denied").alias("denied"))


def per_bucket(log: DataFrame, at: str = "i", width: int = 50, buckets: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(at) / width), F.lit(buckets - 1)).cast("long")
    return log.groupBy(b.alias("bucket")).agg(F.count_if(F.col("status") == "granted").alias("granted"), F.count_if(F.col("status") == "denied").alias("denied"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))


def class_profile(df: DataFrame, label: str, warn_above: float = 5.0) -> DataFrame:
    """One row: samples, classes, largest to smallest ratio, warning."""
    c = class_counts(df, label)
    ratio = F.max("n") / F.greatest(F.min("n"), F.lit(1))
    return c.agg(F.sum("n").alias("n_samples"), F.count("*").alias("n_classes"), F.round(ratio, 6).alias("imbalance"), (ratio > warn_above).alias("warning"))


def imbalance(df: DataFrame, label: str, threshold: float = 3.0) -> DataFrame:
    """The monitor's ratio: 1 with fewer than two classes."""
    c = class_counts(df, label)
    ratio = F.when(F.count("*") < 2, 1.0).otherwise(F.max("n") / F.min("n"))
    return c.agg(F.round(ratio, 6).alias("ratio"), (ratio > threshold).alias("imbalanced"))
