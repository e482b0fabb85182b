"""Streaming forms of the stateful operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.audit import payload

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Chain(StatefulProcessor):
    """One chain's last hash and number of rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(rows)).sort_values(["timestamp", "event_id"])
        last, n = self.last.get() if self.last.exists() else ("", 0)
        prev, own = [], []
        for head, tail in zip(b["head"], b["tail"]):
            prev.append(last)
            last = hashlib.sha256(f"{head}{last}{tail}".encode()).hexdigest()
            own.append(last)
        self.last.update((last, n + len(own)))
        yield pd.DataFrame({"chain_id": key[0], "event_id": b["event_id"], "seq": range(n + 1, n + 1 + len(own)), "prev_hash": prev, "hash": own})

    def close(self) -> None:
        pass


def chain_stream(df: DataFrame) -> DataFrame:
    """Chain rows as they arrive, per ``chain_id``; rows of one micro-batch in order of time, then event.

    A row older than one already chained is appended where it arrives, as a log does. The session needs the
    RocksDB state store (``ROCKSDB``).
    """
    cut = F.split(payload(F.lit("\x00")), "\x00")
    t = df.select("chain_id", "event_id", "timestamp", F.element_at(cut, 1).alias("head"), F.element_at(cut, 2).alias("tail"))
    return t.groupBy("chain_id").transformWithStateInPandas(_Chain(), "chain_id bigint, event_id bigint, seq bigint, prev_hash string, hash string", "Append", "None")


def running_rates(df: DataFrame, pred: str, group: str) -> DataFrame:
    """Positives and totals for each group so far (complete mode): the fairness monitor's counts."""
    return df.groupBy(group).agg(F.count_if(F.col(pred) == 1).alias("positives"), F.count("*").alias("total"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))


def batch_moments(df: DataFrame, seq: str, vector: str, batch: int = 50) -> DataFrame:
    """Count, sum and sum of squares of each (batch, dimension): what the drift monitor needs of a stream."""
    t = df.select(F.floor(F.col(seq) / batch).alias("batch"), F.posexplode(vector).alias("dim", "x"))
    x = F.col("x").cast("double")
    return t.groupBy("batch", "dim").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))


def write_log(df: DataFrame, path: str, checkpoint: str):
    """Append-only JSON lines with a checkpoint, which is the log's write-ahead guarantee."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
