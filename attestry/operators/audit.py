"""Hash-chained audit logs: canonical payload, chaining, verification, summary."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAYLOAD = ("device", "input_shapes", "module_name", "operator_type", "output_hash", "output_shape", "prev_hash", "timestamp")


def _json_string(c: Column) -> Column:
    """A JSON string of ASCII text; other characters must go through ``\\uXXXX`` before."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _ints(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))


def payload(prev: Column) -> Column:
    """The canonical JSON of a row: keys sorted, ``", "`` and ``": "`` between."""
    shapes = F.concat(F.lit("["), F.array_join(F.transform("input_shapes", lambda s: _ints(s)), ", "), F.lit("]"))
    values = {
        "device": _json_string(F.col("device")), "input_shapes": shapes, "module_name": _json_string(F.col("module_name")), "operator_type": _json_string(F.col("operator_type")),
        "output_hash": _json_string(F.col("output_hash")), "output_shape": _ints(F.col("output_shape")), "prev_hash": _json_string(prev), "timestamp": F.col("timestamp").cast("string"),
    }
    return F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), values[k]) for k in PAYLOAD)), F.lit("}"))


def row_hash(prev: Column) -> Column:
    return F.sha2(payload(prev), 256)


def chain(df: DataFrame) -> DataFrame:
    """Add ``prev_hash`` and ``hash`` to rows keyed ``(chain_id, seq)``.

    A chain is sequential by definition: one task folds one chain, holding a batch of its rows at a time and
    one hash. What the fold needs of a row - the payload around ``prev_hash`` - is made by expressions before.
    """
    mark = "\x00"
    cut = F.split(payload(F.lit(mark)), mark)
    t = df.withColumn("__head", F.element_at(cut, 1)).withColumn("__tail", F.element_at(cut, 2))
    spread = t.repartition("chain_id").sortWithinPartitions("chain_id", "seq")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "prev_hash string, hash string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = object(), ""
        for b in batches:
            prev, own = [], []
            for key, head, tail in zip(b["chain_id"], b["__head"], b["__tail"]):
                if key != current:
                    current, last = key, ""
                prev.append(last)
                last = hashlib.sha256(f"{head}{last}{tail}".encode()).hexdigest()
                own.append(last)
            yield b.drop(columns=["__head", "__tail"]).assign(prev_hash=prev, hash=own)

    return spread.mapInPandas(run, schema)


def verify(df: DataFrame, strict: bool = False) -> DataFrame:
    """Per chain: ``n``, ``n_bad``, ``first_bad`` (null if all is well), ``valid``.

    Each row's hash is made again from its own content. ``strict`` also asks that ``prev_hash`` is the hash of
    the row before, which finds deletions and reordering.
    """
    bad = F.coalesce(F.col("hash"), F.lit("")) != row_hash(F.col("prev_hash"))
    t = df
    if strict:
        before = F.lag("hash", 1, "").over(Window.partitionBy("chain_id").orderBy("seq"))
        t = t.withColumn("__before", before)
        bad = bad | (F.col("prev_hash") != F.col("__before"))
    t = t.withColumn("__bad", bad)
    return t.groupBy("chain_id").agg(F.count("*").alias("n"), F.count_if("__bad").alias("n_bad"), F.min(F.when(F.col("__bad"), F.col("seq"))).alias("first_bad"), (~F.bool_or("__bad")).alias("valid"))


def summary(df: DataFrame) -> DataFrame:
    """Per chain: entries, first and last time, different operators, root hash."""
    return df.groupBy("chain_id").agg(
        F.count("*").alias("n"), F.min_by("timestamp", "seq").alias("first_ts"), F.max_by("timestamp", "seq").alias("last_ts"), F.count_distinct("operator_type").alias("n_operators"), F.max_by("hash", "seq").alias("root_hash"),
    )


def with_iso(df: DataFrame) -> DataFrame:
    """The sink's form: nanoseconds as ISO-8601 too."""
    return df.withColumn("iso_timestamp", F.date_format(F.timestamp_micros(F.expr("timestamp div 1000")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def operator_counts(df: DataFrame, k: int = 10) -> DataFrame:
    return df.groupBy("operator_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "operator_type").limit(k)


def steps_of_subject(provenance: DataFrame) -> DataFrame:
    """``(subject_id, step, grad_norm)``: which gradient steps saw which subject."""
    return provenance.select(F.explode(F.array_distinct("subject_ids")).alias("subject_id"), "step", "grad_norm")


def leaf_modules(modules: DataFrame) -> DataFrame:
    """Modules that are nobody's parent."""
    return modules.join(modules.select(F.col("parent").alias("name")).distinct(), "name", "left_anti")
