"""File, record and log sources; sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import CUT
from ..schema import FIELDS, RECORD, with_defaults


def find_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``(path, size)`` of the files under ``root`` by name, recursively, in order of path."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return t.select("path", F.col("length").alias("size")).orderBy("path")


def read_texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``(path, rel, text)`` of whole files; bytes that are no UTF-8 come as U+FFFD."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    path = F.input_file_name()
    base = root.rstrip("/").removeprefix("file://") + "/"
    return t.select(path.alias("path"), F.substring_index(path, base, -1).alias("rel"), F.col("value").alias("text"))


def read_records(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of JSON-lines files, and of ``*.json`` files that hold one record or an array of them.

    Malformed lines and files are skipped, unknown keys dropped, missing ones defaulted. ``input_seq`` orders by file, JSON
    lines first, then name, then place: it breaks ties as the input stands. A file is read whole for its places, so
    record files are to be of a bounded size; how many there are is not bounded.
    """
    names = [T.StructField(f.name, f.dataType) for f in RECORD.fields]
    raw = spark.read.text(list(paths), wholetext=True).select("value", F.col("_metadata.file_path").alias("f"))
    plain = F.lower("f").endswith(".json")
    parts = raw.select("f", plain.alias("plain"), F.posexplode(F.when(plain, F.array("value")).otherwise(F.split("value", "\r?\n"))).alias("i", "value")).where("trim(value) <> ''")
    known = parts.where(F.try_parse_json("value").isNotNull())
    text = F.trim("value")
    listed = known.where(F.col("plain") & text.startswith("[")).select("f", "plain", F.posexplode(F.from_json("value", T.ArrayType(T.StructType(names)))).alias("i", "r"))
    single = known.where(text.startswith("{")).select("f", "plain", "i", F.from_json("value", T.StructType(names)).alias("r"))
    rows = single.unionByName(listed).where("r is not null")
    # Files are numbered once, by name: a row for each file.
    order = rows.select("f", "plain").distinct()
    order = order.select("f", F.row_number().over(Window.orderBy("plain", "f")).cast("long").alias("n"))
    return with_defaults(rows.join(order, "f").select("r.*", F.shiftleft("n", 32).bitwiseOR(F.col("i").cast("long")).alias("input_seq")))


def read_audit(spark: SparkSession, *paths: str) -> DataFrame:
    shape = "timestamp bigint, module_name string, operator_type string, input_shapes array<array<int>>, output_shape array<int>, output_hash string, device string, prev_hash string, hash string, chain_id string, seq bigint"
    return spark.read.schema(shape).json(list(paths)).where("hash is not null")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run_id string, fairness double, fairness_failed boolean, epsilon double, delta double, accuracy double, drift boolean, root_hash string, n_entries bigint").option("multiLine", True).json(path)


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of structured legal JSON, a row for each obligation."""
    shape = "articles array<struct<number: string, title: string, file_path: string, key_points: array<string>, obligations: array<string>>>"
    a = spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("articles").alias("a"))
    return a.select("a.number", "a.title", F.posexplode_outer("a.obligations").alias("i", "obligation"))


# -- sinks -------------------------------------------------------------------------------------------------------

_CSV = [f for f in FIELDS if f not in ("raw_text", "relations", "export_survival", "annotations", "metadata", "timestamp", "end_line")]


def csv_rows(df: DataFrame) -> DataFrame:
    """The flat form: tags joined, confidences with three places, docstrings cut, a column for each export target."""
    from ..functions import dims

    special: dict[str, Column] = {
        "compliance_tags": F.array_join("compliance_tags", "; "), "docstring": F.substring("docstring", 1, 200),
        **{c: F.format_string("%.3f", F.col(c)) for c in ("extraction_confidence", "mapping_confidence")},
    }
    targets = [F.coalesce(F.try_element_at("export_survival", F.lit(t)), F.lit("")).alias(f"export_{t}") for t in dims.TARGETS]
    return df.select(*(special.get(f, F.col(f)).alias(f) for f in _CSV), *targets)


def write_csv(df: DataFrame, path: str) -> None:
    csv_rows(df).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def report_lines(df: DataFrame) -> DataFrame:
    """Ordered lines of the Markdown report: ``(section, at, line)``."""
    from ..functions.exprs import confidence_label, tag_label
    from ..operators.organize import best_per_name

    best = best_per_name(df)
    head = best.groupBy("tag").agg(F.count("*").alias("n")).select("tag", F.lit(0).alias("at"), F.lit("").alias("name"), F.concat(F.lit("## "), tag_label(F.col("tag")), F.lit(" ("), "n", F.lit(")")).alias("line"))
    row = F.concat(F.lit("- `"), "entity_name", F.lit("` ("), confidence_label(F.col("mapping_confidence")), F.lit(") "), "source_file", F.lit(":"), "start_line")
    body = best.select("tag", F.lit(1).alias("at"), F.col("entity_name").alias("name"), row.alias("line"))
    return head.unionByName(body).orderBy("tag", "at", "name").select("tag", "at", "line")


def notebook(queries: dict[str, str]) -> str:
    """An nbformat 4 notebook with one SQL cell for each query."""
    cell = lambda kind, text: {"cell_type": kind, "metadata": {}, "source": text.splitlines(True), **({"outputs": [], "execution_count": None} if kind == "code" else {})}
    cells = [c for name, sql in queries.items() for c in (cell("markdown", f"## {name}"), cell("code", f'spark.sql("""{sql}""").show()'))]
    return json.dumps({"nbformat": 4, "nbformat_minor": 5, "metadata": {}, "cells": cells}, indent=1)


def metric_rows(snapshot: DataFrame, run: str, step: int = 0) -> DataFrame:
    """Long metrics ``(run_id, step, key, value)`` for a tracker."""
    from ..operators.snapshots import unpivot

    return unpivot(snapshot).select(F.lit(run).alias("run_id"), F.lit(step).alias("step"), F.col("metric").alias("key"), "value")


class Manifest:
    """Which phases are done, in a small JSON file beside the outputs; written whole, then moved into place."""

    def __init__(self, path: str):
        self.path = Path(path)

    def done(self) -> dict:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def mark(self, phase: str, **what) -> None:
        new = self.path.with_suffix(".tmp")
        new.write_text(json.dumps(self.done() | {phase: what}, sort_keys=True))
        new.replace(self.path)

    def reset(self) -> None:
        self.path.unlink(missing_ok=True)


def cut(text: str, most: int = 5000) -> str:
    return text if len(text) <= most else text[:most] + CUT
