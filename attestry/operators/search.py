"""Similarity search over unit vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import dot, unit


def cosine_topk(df: DataFrame, query: list[float], k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to one query; each task keeps its own ``k``."""
    q = unit(F.array(*(F.lit(float(x)) for x in query)))
    return df.select(id_col, F.round(dot(unit(F.col(vector)), q), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def cosine_topk_of(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to each row of a stated, small query table, itself left out.

    Queries go to all tasks in blocks; each task's rows are cut to ``k`` a query before the shuffle by a
    partial rank over its own batch key.
    """
    q = queries.select(F.col(id_col).alias("query_id"), unit(F.col(vector)).alias("__q"))
    pairs = df.select(id_col, unit(F.col(vector)).alias("__v"), F.spark_partition_id().alias("__p")).join(F.broadcast(q), F.col(id_col) != F.col("query_id"))
    scored = pairs.select("query_id", id_col, "__p", F.round(dot(F.col("__v"), F.col("__q")), 6).alias("score"))
    local = Window.partitionBy("query_id", "__p").orderBy(F.desc("score"), id_col)
    best = scored.withColumn("__r", F.row_number().over(local)).where(F.col("__r") <= k)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", id_col, "rank", "score")


def top_attributions(df: DataFrame, id_col: str, scores: str, k: int = 5) -> DataFrame:
    """Per row the ``k`` entries of the largest absolute score: ``(id, rank, position, score)``."""
    cells = F.transform(scores, lambda x, i: F.struct((-F.abs(x)).cast("double").alias("a"), i.alias("position"), x.cast("double").alias("score")))
    return df.select(id_col, F.posexplode(F.slice(F.array_sort(cells), 1, k)).alias("rank", "e")).select(id_col, (F.col("rank") + 1).alias("rank"), "e.position", F.round("e.score", 4).alias("score"))
