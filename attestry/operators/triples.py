"""Records as triples, and the fixed graph queries over the record table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import tag_uri

BASE = "https://example.org/evidence#"
_IDENTITY = {"entity_name": "name", "entity_type": "entityType", "subcategory": "subcategory", "language": "language", "source_file": "sourceFile", "module_path": "modulePath", "qualified_name": "qualifiedName"}
_NOTES = {"lifecycle_phase": "lifecyclePhase", "execution_level": "executionLevel", "distributed_safety": "distributedSafety", "mapping_rationale": "mappingRationale"}
CLASSES, LINKS = ("Entity", "ExportSurvival", "Article"), ("hasComplianceTag", "hasExportSurvival")


def triples(df: DataFrame) -> DataFrame:
    """``(s, p, o, kind)``; kind is uri, string, integer or decimal. A graph is a set: repeats are dropped."""
    uri = F.concat(F.lit(BASE), F.col("id"))
    row = lambda p, o, kind: F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("kind"))
    plain = [F.when(F.col(c) != "", row(p, F.col(c), "string")) for c, p in (*_IDENTITY.items(), *_NOTES.items())]
    plain += [
        row("type", F.lit(BASE + "Entity"), "uri"), F.when(F.col("start_line") != 0, row("startLine", F.col("start_line"), "integer")),
        F.when(F.col("docstring") != "", row("docstring", F.substring("docstring", 1, 500), "string")),
        *(row(p, F.round(F.col(c), 4).cast("decimal(10,4)"), "decimal") for c, p in (("extraction_confidence", "extractionConfidence"), ("mapping_confidence", "mappingConfidence"))),
    ]
    tags = F.transform(F.filter("compliance_tags", lambda t: tag_uri(t).isNotNull()), lambda t: F.struct(F.lit("hasComplianceTag").alias("p"), tag_uri(t).alias("o"), F.lit("uri").alias("kind")))
    some = df.where("id <> ''")
    own = some.select(uri.alias("s"), F.explode(F.concat(F.array_compact(F.array(*plain)), tags)).alias("t")).select("s", "t.*")
    e = some.select(uri.alias("u"), F.explode("export_survival").alias("target", "status"))
    node = F.concat("u", F.lit("_survival_"), "target")
    four = F.array(
        F.struct(F.col("u").alias("s"), F.lit("hasExportSurvival").alias("p"), node.alias("o"), F.lit("uri").alias("kind")), F.struct(node.alias("s"), F.lit("type").alias("p"), F.lit(BASE + "ExportSurvival").alias("o"), F.lit("uri").alias("kind")),
        F.struct(node.alias("s"), F.lit("exportFormat").alias("p"), F.col("target").alias("o"), F.lit("string").alias("kind")), F.struct(node.alias("s"), F.lit("survivalStatus").alias("p"), F.col("status").alias("o"), F.lit("string").alias("kind")),
    )
    return own.unionByName(e.select(F.explode(four).alias("t")).select("t.*")).distinct()


def schema_triples(spark) -> DataFrame:
    data = [*_IDENTITY.values(), *_NOTES.values(), "startLine", "docstring", "extractionConfidence", "mappingConfidence", "exportFormat", "survivalStatus"]
    rows = [(BASE + x, "type", k) for k, xs in (("Class", CLASSES), ("ObjectProperty", LINKS), ("DatatypeProperty", data)) for x in xs]
    return spark.createDataFrame(rows, "s string, p string, o string")


def lines(t: DataFrame) -> DataFrame:
    """N-Triples lines."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), "\n", r"\\n"), F.lit('"'))
    typed = F.when(F.col("kind") == "uri", F.concat(F.lit("<"), "o", F.lit(">"))).when(F.col("kind") == "string", quoted).otherwise(F.concat(quoted, F.lit("^^<http://www.w3.org/2001/XMLSchema#"), "kind", F.lit(">")))
    return t.select(F.concat(F.lit("<"), "s", F.lit(f"> <{BASE}"), "p", F.lit("> "), typed, F.lit(" .")).alias("value"))


# -- fixed queries -------------------------------------------------------------------------------------------


def _tagged(df: DataFrame) -> DataFrame:
    return df.withColumn("tag", F.explode(F.array_distinct("compliance_tags")))


def coverage_matrix(df: DataFrame) -> DataFrame:
    return _tagged(df).groupBy("tag").agg(F.count_distinct("id").alias("n"), F.avg("mapping_confidence").alias("mean_confidence"))


def article_gap(df: DataFrame, tag: str = "eu_ai_act_art_14") -> DataFrame:
    return df.where(F.array_contains("compliance_tags", tag)).select("id", "entity_name", "entity_type", "mapping_confidence", "mapping_rationale")


def determinism_census(df: DataFrame) -> DataFrame:
    d = F.coalesce(F.try_element_at("metadata", F.lit("deterministic_enforceable")), F.when(F.col("subcategory") == "nondeterministic_candidate", "nondeterministic"))
    return df.select("id", "entity_name", d.alias("determinism"), "source_file", "extraction_confidence", "mapping_confidence").where("determinism is not null")


def export_gaps(df: DataFrame) -> DataFrame:
    """Tagged, with survival known, and not surviving compilation; once for each EU tag."""
    t = _tagged(df.where((F.size("export_survival") > 0) & ~F.coalesce(F.try_element_at("export_survival", F.lit("torch_compile")) == "yes", F.lit(False))))
    return t.where(F.col("tag").startswith("eu_ai_act")).select("id", "entity_name", "tag", "source_file")


def test_coverage(df: DataFrame) -> DataFrame:
    return _tagged(df.where("entity_type = 'test_case'")).where(F.col("tag").startswith("eu_ai_act")).groupBy("tag").agg(F.count_distinct("id").alias("n"))


def hooks_surviving(df: DataFrame) -> DataFrame:
    return df.where((F.col("subcategory") == "hook_definition") & (F.try_element_at("export_survival", F.lit("torch_compile")) == "yes")).select("id", "entity_name", "source_file")


def high_confidence(df: DataFrame, least: float = 0.8) -> DataFrame:
    return _tagged(df.where(F.col("mapping_confidence") >= least)).where(F.col("tag").startswith("eu_ai_act")).groupBy("tag").agg(F.count_distinct("id").alias("n"))


def ask(df: DataFrame) -> DataFrame:
    return df.agg((F.count("*") > 0).alias("answer"))
