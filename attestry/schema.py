"""The record schema and its defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RELATION = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "target", "source", "subject", "relation", "object")])
_STR, _INT, _DBL = T.StringType(), T.IntegerType(), T.DoubleType()
_MAP = T.MapType(_STR, _STR)
_TYPES = {
    "start_line": _INT, "end_line": _INT, "relations": T.ArrayType(RELATION), "compliance_tags": T.ArrayType(_STR), "export_survival": _MAP,
    "extraction_confidence": _DBL, "mapping_confidence": _DBL, "annotations": _MAP, "metadata": _MAP,
}
FIELDS = (
    "id source_file language entity_name entity_type subcategory module_path qualified_name start_line end_line raw_text docstring signature relations compliance_tags "
    "lifecycle_phase execution_level distributed_safety distributed_safety_notes export_survival extraction_confidence mapping_confidence mapping_rationale extractor annotations metadata timestamp"
).split()
RECORD = T.StructType([T.StructField(n, _TYPES.get(n, _STR)) for n in FIELDS])


def default(name: str):
    kind = _TYPES.get(name, _STR)
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    value = 1.0 if name == "extraction_confidence" else {_INT: 0, _DBL: 0.0}.get(kind, "")
    return F.lit(value).cast(kind)


def with_defaults(df: DataFrame) -> DataFrame:
    """All 27 fields, typed, a missing or null one as its default; other columns but ``input_seq`` are dropped."""
    have = set(df.columns)
    cols = [(F.coalesce(F.col(n).cast(_TYPES.get(n, _STR)), default(n)) if n in have else default(n)).alias(n) for n in FIELDS]
    return df.select(*cols, *(["input_seq"] if "input_seq" in have else []))
