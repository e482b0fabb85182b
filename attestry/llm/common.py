"""Helpers shared by the training-data operators: table access and materialised intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: space and \x09-\x0D.
SPACE = r"\x20\x09-\x0D"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session on one machine (``local[...]``) may name none: its own temporary folder then serves for this
    session. On a cluster that is an error, because executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="attestry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def drop(spark: SparkSession, path: str) -> None:
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath)


class Scratch:
    """Intermediate tables, written as Parquet to the shared folder and read again.

    A written table cuts the lineage and survives the loss of executors. ``free`` drops a table that no
    later plan reads, ``free_but`` all but those that one reads; what is left goes when the application's file system
    is closed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name.replace("-", "_")
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        fs, jpath = _fs(spark, self.root)
        fs.mkdirs(jpath)
        fs.deleteOnExit(jpath)
        self._n, self._paths = 0, set()

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = os.path.join(self.root, f"{self._n:03d}-{label}")
        self._n += 1
        with self._tidy():
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self._paths.add(path)
        return out

    def bucketed(self, df: DataFrame, key: str, label: str) -> DataFrame:
        """``save``, with the rows of a key in one bucket: what groups or joins by it later moves none of them."""
        name, path = f"{self.name}_{uuid.uuid4().hex}", os.path.join(self.root, f"{self._n:03d}-{label}")
        self._n += 1
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with self._tidy():
            df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").bucketBy(n, key).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out._scratch_path = path
        self._paths.add(path)
        return out

    @contextmanager
    def _tidy(self) -> Iterator[None]:
        """A table's shuffle files go as soon as it is written: what reads it never asks for them again."""
        old = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            yield
        finally:
            self.spark.conf.unset(_CLEANUP) if old is None else self.spark.conf.set(_CLEANUP, old)

    def free(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                drop(self.spark, path)

    def free_but(self, *tables: DataFrame) -> None:
        left = {t._scratch_path for t in tables}
        for path in self._paths - left:
            drop(self.spark, path)
        self._paths &= left


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def rows_with_key(df: DataFrame, id_col: str, text: str, keep: str | None = None) -> DataFrame:
    """``doc`` (``id`` and 128 bits of the text: ``t1``, ``t2``) and ``text``; ``keep`` names a struct of the whole row.

    Rows that share id and text share the key; null ids and repeated ids of different texts have keys of their own.
    """
    t = F.col(f"`{text}`").cast("string")
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(1), t).alias("t2"))
    row = [F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(keep)] if keep else []
    return df.select(key.alias("doc"), t.alias("text"), *row)
