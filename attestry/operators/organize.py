"""Dedup, cross references, index, statistics and validation of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.exprs import heat_module, module_top, populated
from ..schema import FIELDS

KEY = ("source_file", "entity_name", "entity_type", "start_line", "subcategory")
_ARRAYS, _MAPS, _NUMBERS = ("relations", "compliance_tags"), ("export_survival", "annotations", "metadata"), ("start_line", "end_line", "extraction_confidence", "mapping_confidence")
_TEXTS = tuple(f for f in FIELDS if f not in (*_ARRAYS, *_MAPS, *_NUMBERS))


def richness() -> Column:
    kinds = {f: "array" if f in _ARRAYS else "map" if f in _MAPS else "number" if f in _NUMBERS else "text" for f in FIELDS}
    return populated(kinds)


def ranked(df: DataFrame) -> DataFrame:
    """``rn``: 1 for the record of its key with the most populated fields, first come first among equals."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("populated"), "input_seq")
    return df.withColumn("populated", richness()).withColumn("rn", F.row_number().over(w))


def dedup(df: DataFrame) -> DataFrame:
    """One record per key: the richest, filled from the others in order.

    Tags and relations are united in order (the primary's own repeats stay), maps are merged with the earlier
    record winning, confidences are the largest, and empty strings take the first other's value, but for id,
    extractor and timestamp. Records must carry ``input_seq``. A key's group holds the copies of one source
    location, which is what is gathered.
    """
    g = df.withColumn("populated", richness())
    one = F.struct(*(F.col(f) for f in FIELDS))
    group = F.array_sort(F.collect_list(F.struct((-F.col("populated")).alias("p"), F.col("input_seq").alias("s"), one.alias("r"))), _by_rank)
    t = g.groupBy(*KEY).agg(group.alias("g")).select(F.transform("g", lambda x: x["r"]).alias("r"))
    r = F.col("r")
    first, rest = F.element_at(r, 1), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))
    out = {}
    for f in FIELDS:
        if f in ("extraction_confidence", "mapping_confidence"):
            c = F.expr(f"array_max(transform(r, x -> x.{f}))")
        elif f == "compliance_tags":
            c = F.aggregate(rest, first[f], lambda a, x: F.concat(a, F.array_except(x["compliance_tags"], a)))
        elif f == "relations":
            c = F.aggregate(rest, first[f], _add_relations)
        elif f in _MAPS:
            c = F.expr(f"map_from_entries(aggregate(slice(r, 2, greatest(size(r) - 1, 0)), map_entries(r[0].{f}), (a, x) -> concat(a, filter(map_entries(x.{f}), e -> not exists(a, k -> k.key = e.key)))))")
        elif f in ("id", "extractor", "timestamp") or f in ("start_line", "end_line"):
            c = first[f]
        else:
            c = F.expr(f"coalesce(try_element_at(filter(transform(r, x -> x.{f}), v -> v <> ''), 1), '')")
        out[f] = c
    return t.select(*(c.alias(f) for f, c in out.items()))


def _by_rank(a: Column, b: Column) -> Column:
    less = lambda x, y: (x["p"] < y["p"]) | (x["p"] == y["p"]) & (x["s"] < y["s"])
    return F.when(less(a, b), -1).when(less(b, a), 1).otherwise(0)


def _add_relations(a: Column, x: Column) -> Column:
    same = lambda p, q: F.coalesce(p["type"], F.lit("")).eqNullSafe(F.coalesce(q["type"], F.lit(""))) & F.coalesce(p["target"], F.lit("")).eqNullSafe(F.coalesce(q["target"], F.lit("")))
    return F.aggregate(x["relations"], a, lambda b, r: F.when(F.exists(b, lambda o: same(o, r)), b).otherwise(F.array_append(b, r)))


# -- cross references ----------------------------------------------------------------------------------------


def relation_edges(df: DataFrame) -> DataFrame:
    t = df.select("id", F.explode("relations").alias("r"))
    return t.select(F.col("id").alias("source"), F.coalesce("r.target", F.lit("")).alias("target"), F.coalesce("r.type", F.lit("unknown")).alias("type"))


def name_edges(texts: DataFrame, names: DataFrame, min_name: int = 8, min_token: int = 4) -> DataFrame:
    """``(source, target, name)`` where a text holds another record's name.

    ``texts(id, text)``, ``names(id, name)``. Names without a token (between dots and underscores) of ``min_token`` characters
    that starts with a letter have no edges. Of several records with one name the last is its target, by id. All names
    are looked for, however many there are and however common their words.

    Equal texts are searched once. A text is cut only where a name may lie: ``min_name`` code units after a dot or an
    underscore (at every place, if there are names without one early enough) tell how long the names are that go on like
    this, and how far they start before; what is cut out meets the one name that it equals.
    """
    wide = 2 * min_name
    n = names.where((F.length("name") >= min_name) & F.col("name").rlike(rf"(^|[._])[a-zA-Z][^._]{{{min_token - 1},}}")).groupBy("name").agg(F.max("id").alias("target"))
    # Code units are found by their place; characters would have to be counted.
    n = n.withColumns({"u": F.encode("name", "UTF-16BE"), "sep": F.length(F.encode(F.regexp_extract("name", "^[^._]*[._]", 0), "UTF-16BE"))})
    n = n.withColumns({"size": F.length("u"), "off": F.when(F.col("sep") + wide <= F.length("u"), F.col("sep")).otherwise(0)})
    shape = n.select(F.xxhash64(F.expr(f"substring(u, off + 1, {wide})")).alias("h"), "off", "size").distinct()
    t = texts.where(F.length("text") >= min_name).select("text").distinct().select(F.xxhash64("text").alias("k"), F.encode("text", "UTF-16BE").alias("u"))
    place = t.join(F.broadcast(n.agg(F.bool_or(F.col("off") == 0).alias("all"))), how="cross").select("k", "u", "all", F.explode(F.expr(f"sequence(1, length(u) - {wide} + 1, 2)")).alias("at"))
    place = place.where("all or substring(u, at - 2, 2) in (X'002E', X'005F') and at > 2").select("k", "at", F.xxhash64(F.expr(f"substring(u, at, {wide})")).alias("h"))
    # Hashes that collide name more places, never fewer; what is cut out is compared as it is.
    cut = place.join(shape, "h").where("at > off").select("k", (F.col("at") - F.col("off")).alias("at"), "size").distinct()
    found = cut.join(t, "k").select("k", F.expr("substring(u, at, size)").alias("u")).join(n.select("u", "target", "name"), "u").select("k", "target", "name").distinct()
    held = texts.select(F.col("id").alias("source"), "text", F.xxhash64("text").alias("k")).join(found, "k")
    return held.where((F.col("source") != F.col("target")) & F.col("text").contains(F.col("name"))).select("source", "target", "name")


def co_members(df: DataFrame, by: str, member: str) -> DataFrame:
    """Keys with more than one member: count, least and largest member.

    Members themselves are rows of the input: a key may hold a large share of them, so they are not listed in
    one value; ``co_member_rows`` gives them as rows.
    """
    g = df.select(by, member).distinct().groupBy(by).agg(F.count("*").alias("n"), F.min(member).alias("first"), F.max(member).alias("last"))
    return g.where("n > 1")


def co_member_rows(df: DataFrame, by: str, member: str) -> DataFrame:
    rows = df.select(by, member).distinct()
    return rows.join(co_members(df, by, member).select(by), by, "left_semi")


def nodes(edges: DataFrame) -> DataFrame:
    """Different ends that are neither empty nor template placeholders."""
    plain = lambda c: ~(F.col(c).contains("{{") | F.col(c).contains("}}"))
    e = edges.where(plain("source") & plain("target"))
    return e.select(F.explode(F.array("source", "target")).alias("node")).where("node <> ''").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


# -- index and statistics ------------------------------------------------------------------------------------

DIMENSIONS = ("entity_name", "source_file", "language", "entity_type", "subcategory", "lifecycle_phase", "execution_level", "compliance_tags")


def index(df: DataFrame) -> DataFrame:
    """``(dimension, key, record_id)`` over all eight dimensions, empty keys left out."""
    keys = F.concat(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("key")) for d in DIMENSIONS[:-1])), F.transform("compliance_tags", lambda t: F.struct(F.lit("compliance_tags").alias("dimension"), t.alias("key"))))
    return df.select(F.col("id").alias("record_id"), F.explode(keys).alias("k")).select("k.dimension", "k.key", "record_id").where("key <> ''")


def index_sizes(df: DataFrame) -> DataFrame:
    return index(df).groupBy("dimension", "key").agg(F.count("*").alias("n"))


def count_by(df: DataFrame, field: str) -> DataFrame:
    return df.where(F.col(field) != "").groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))


def density(df: DataFrame) -> DataFrame:
    tagged = F.count_if(F.size("compliance_tags") > 0)
    return df.agg(F.count("*").alias("total"), tagged.alias("tagged"), F.coalesce(F.round(F.try_divide(tagged, F.count("*")), 4), F.lit(0.0)).alias("density"))


def per_tag(df: DataFrame, distinct: bool = False) -> DataFrame:
    """Repeated tags of a record count twice, or once if ``distinct``."""
    tags = F.array_distinct("compliance_tags") if distinct else F.col("compliance_tags")
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """Five bins of 0.2; what lies outside counts in the outer ones; empty bins are listed."""
    b = F.least(F.greatest(F.floor(F.col(value) * 5 + F.lit(1e-9)), F.lit(0)), F.lit(4)).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    all_bins = df.sparkSession.range(5).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def per_module(df: DataFrame) -> DataFrame:
    return df.where((F.size("compliance_tags") > 0) & (F.col("module_path") != "")).groupBy(module_top(F.col("module_path")).alias("module")).agg(F.count("*").alias("n"))


def module_density(df: DataFrame) -> DataFrame:
    g = df.groupBy(heat_module(F.col("module_path"), F.col("source_file")).alias("module"))
    tagged = F.count_if(F.size("compliance_tags") > 0)
    return g.agg(F.count("*").alias("total"), tagged.alias("tagged"), F.round(F.try_divide(tagged, F.count("*")), 4).alias("density"))


def survival_counts(df: DataFrame) -> DataFrame:
    t = df.select(F.explode("export_survival").alias("target", "status")).withColumn("s", F.lower("status"))
    return t.groupBy("target").agg(*(F.count_if(F.col("s") == k).alias(k) for k in ("yes", "no", "partial")))


def survival_matrix(df: DataFrame) -> DataFrame:
    """Counts over the five fixed targets, targets without a record included."""
    t = df.select(F.explode(F.array(*(F.struct(F.lit(x).alias("target"), F.try_element_at("export_survival", F.lit(x)).alias("s")) for x in dims.TARGETS))).alias("e"))
    return t.groupBy("e.target").agg(*(F.count_if(F.col("e.s") == k).alias(k) for k in ("yes", "no", "partial")))


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def gaps(df: DataFrame) -> DataFrame:
    """Every article of the fixed list with its number of records."""
    articles = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, dims.ARTICLES))).alias("tag"))
    return articles.join(per_tag(df, distinct=True), "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"))


def best_per_name(df: DataFrame) -> DataFrame:
    """For each tag the surest record of a qualified name; records without one all stay."""
    t = df.withColumn("tag", F.explode("compliance_tags"))
    w = Window.partitionBy("tag", "qualified_name", F.when(F.col("qualified_name") == "", F.col("id"))).orderBy(F.desc("mapping_confidence"), "input_seq")
    return t.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


# -- validation ----------------------------------------------------------------------------------------------


def issues(df: DataFrame) -> DataFrame:
    """``(record_id, rule, level, field, message)``, in the rules' order by ``rule``."""
    c = F.col
    bad = lambda f: (c(f) < 0) | (c(f) > 1)
    rules = [
        *((c(f) == "", "error", f, f"missing {f}") for f in ("id", "source_file", "entity_name", "entity_type")),
        (c("raw_text") == "", "info", "raw_text", "empty raw_text"), (F.length("raw_text") > 5000, "warning", "raw_text", "raw_text over 5000 characters"),
        (bad("extraction_confidence"), "warning", "extraction_confidence", "outside 0..1"), (bad("mapping_confidence"), "warning", "mapping_confidence", "outside 0..1"),
        ((c("language") != "") & ~c("language").isin(*dims.LANGUAGES), "warning", "language", "unknown language"),
        ((c("entity_type") != "") & ~c("entity_type").isin(*dims.ENTITY_TYPES), "warning", "entity_type", "unknown entity_type"),
        (c("docstring") == "", "info", "docstring", "no docstring"), (F.size("compliance_tags") == 0, "info", "compliance_tags", "no tags"),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(i).alias("rule"), F.lit(level).alias("level"), F.lit(f).alias("field"), F.lit(m).alias("message"))) for i, (test, level, f, m) in enumerate(rules))))
    return df.select(c("id").alias("record_id"), F.explode(found).alias("i")).select("record_id", "i.*")


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Every occurrence of an id but the first, by ``input_seq``; of a tie for the first place all but one.

    Occurrences are counted before they are compared, so that one id with many records is no sort in one task.
    """
    places = df.where("id <> ''").groupBy("id", "input_seq").agg(F.count("*").cast("int").alias("n"))
    first = places.groupBy("id").agg(F.min("input_seq").alias("first"))
    again = F.array_repeat(F.lit(0), F.col("n") - (F.col("input_seq") == F.col("first")).cast("int"))
    return places.join(first, "id").select(F.col("id").alias("record_id"), "input_seq", F.explode(again)).drop("col")


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("level").agg(F.count("*").alias("n"))
