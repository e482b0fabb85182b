"""Annotators: row-local rewrites of records, one ``select`` each, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.exprs import _any

_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that the optimizer will not fold into every place that reads them."""
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("__once")
    return df.select("*", made).select(*df.columns, "__once.*")


def _tags(*tags: str) -> Column:
    return F.array(*map(F.lit, tags))


def add_tags(old: Column, new: Column) -> Column:
    """Ordered union: what ``old`` has stays as it is, repeats included; new tags follow, each once."""
    return F.concat(old, F.array_except(new, old))


def lookup(names: dict[str, list[str]], key: Column) -> Column:
    table = F.create_map(*(x for n, tags in names.items() for x in (F.lit(n), F.array(*map(F.lit, tags)))))
    return F.coalesce(F.try_element_at(table, key), _none())


def hook_consumers(df: DataFrame) -> DataFrame:
    call = F.regexp_extract_all("raw_text", F.lit(rf"(?m)(?:^|[.\s])({'|'.join(sorted(dims.HOOKS))})\s*\("), F.lit(1))
    defined = F.regexp_extract_all("raw_text", F.lit(rf"(?m)def\s+({'|'.join(sorted(dims.HOOKS))})\s*\("), F.lit(1))
    already = F.col("subcategory") == "hook_consumer"
    calls = ~already & (F.col("raw_text") != "") & (F.col("subcategory") != "hook_definition") & (F.size(F.array_except(call, defined)) > 0)
    why = F.lit("Hook consumer: this code invokes a compliance hook point")
    hit = F.col("__hit")
    t = once(df, __hit=F.when(already, 1).when(calls, 2).otherwise(0))
    return t.withColumns({
        "compliance_tags": F.when(hit > 0, add_tags(F.col("compliance_tags"), _tags("eu_ai_act_art_61"))).otherwise(F.col("compliance_tags")),
        "mapping_confidence": F.when(hit > 0, F.greatest("mapping_confidence", F.lit(0.85))).otherwise(F.col("mapping_confidence")),
        "mapping_rationale": F.when((hit == 2) | (hit == 1) & (F.col("mapping_rationale") == ""), why).otherwise(F.col("mapping_rationale")),
        "subcategory": F.when(hit == 2, "hook_consumer").otherwise(F.col("subcategory")),
    }).drop("__hit")


def _name_is(name: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | (name == w) | name.startswith(w + "_") | name.endswith("_" + w)
    return out


def structural_tags() -> Column:
    """Tags from subcategory, inheritance and name."""
    sub, name = F.col("subcategory"), F.lower("entity_name")
    inherits = F.exists("relations", lambda r: F.coalesce(r["target"], F.lit("")).contains("autograd.Function") | F.lower(F.coalesce(r["target"], F.lit(""))).contains("autograd_function"))
    decides = F.col("entity_type").isin("function", "method") & _name_is(name, "predict", "classify", "score", "decision")
    rules = [
        (sub == "autograd_extension", ("eu_ai_act_art_15",)), (sub == "hook_consumer", ("eu_ai_act_art_61",)), (inherits, ("eu_ai_act_art_15",)), (sub == "hook_definition", ("eu_ai_act_art_14", "eu_ai_act_art_12")), (sub == "override_protocol", ("eu_ai_act_art_14",)), (sub == "data_loading", ("gdpr_art_5", "eu_ai_act_art_10")), (decides, ("gdpr_art_22", "eu_ai_act_art_13")),
        (_any(name, "privacy _private anonymi pseudonym dp_optimizer grad_sample noise_multi per_sample".split()), ("gdpr_art_25",)),
        (_any(name, "encrypt decrypt ssl_ _ssl tls_ _tls secure_ _secure hmac hash_data hash_tensor checksum verify_key certif crypto".split()), ("gdpr_art_32",)),
    ]
    return F.array_distinct(F.concat(*(F.when(test, _tags(*tags)).otherwise(_none()) for test, tags in rules)))


def phrase_hits(phrases: list[tuple[str, list[str]]], doc: Column) -> Column:
    """The phrases (``p``) that a text holds and their tags (``t``), in order."""
    table = F.array(*(F.struct(F.lit(p).alias("p"), F.array(*map(F.lit, t)).alias("t")) for p, t in phrases))
    # A lambda's variable keeps its value: the text is lowered once, not for each phrase.
    return F.element_at(F.transform(F.array(F.lower(doc)), lambda low: F.filter(table, lambda x: F.contains(low, x["p"]))), 1)


def hit_tags(hit: Column) -> tuple[Column, Column]:
    return F.flatten(F.transform(hit, lambda x: x["t"])), F.array_sort(F.transform(hit, lambda x: x["p"]))


def phrase_tags(phrases: list[tuple[str, list[str]]], doc: Column) -> tuple[Column, Column]:
    """Tags and matched phrases (sorted) of a text, phrases tried in order."""
    return hit_tags(phrase_hits(phrases, doc))


def tag_articles(df: DataFrame, names: dict[str, list[str]] | None = None, phrases: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Three tiers: known names, structure, phrases of the docstring; why is noted if the tags changed."""
    names, phrases = dims.NAMES if names is None else names, dims.PHRASES if phrases is None else phrases
    by_phrase, said = hit_tags(F.col("__hits"))
    t = once(df, __hits=phrase_hits(phrases, F.col("docstring")))
    t = once(t, __1=lookup(names, F.col("entity_name")), __2=structural_tags(), __3=by_phrase, __p=said)
    one, two, three = (F.size(c) > 0 for c in ("__1", "__2", "__3"))
    new = add_tags(add_tags(add_tags(F.col("compliance_tags"), F.col("__1")), F.col("__2")), F.col("__3"))
    quoted = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    parts = F.array_compact(F.array(
        F.when(one, F.concat(F.lit("Tier-1 name match: '"), "entity_name", F.lit("' -> "), quoted("__1"))),
        F.when(two, F.concat(F.lit("Tier-2 structural: subcategory='"), "subcategory", F.lit("' -> "), quoted("__2"))),
        F.when(three, F.concat(F.lit("Tier-3 semantic: phrases="), quoted("__p"))),
    ))
    conf = F.greatest(F.col("mapping_confidence"), F.when(one, 0.8), F.when(two, 0.85), F.when(three, 0.5))
    t = once(t, __new=new)
    changed = F.size(F.array_except("__new", "compliance_tags")) > 0
    return t.withColumns({"mapping_confidence": conf, "mapping_rationale": F.when(changed, F.array_join(parts, "; ")).otherwise(F.col("mapping_rationale")), "compliance_tags": F.col("__new")}).drop("__hits", "__1", "__2", "__3", "__p", "__new")


COMPILED_KEYS = ("CompositeExplicitAutograd", "FuncTorchBatched")


def execution_level(df: DataFrame) -> DataFrame:
    c = F.col
    raw = c("raw_text")
    level = (
        F.when(c("subcategory") == "graph_break_reason", "compiled_graph").when(c("source_file").contains("_dynamo"), "compiled_graph")
        .when(c("entity_name").isin(*COMPILED_KEYS) | F.coalesce(F.try_element_at("metadata", F.lit("dispatch_key")).isin(*COMPILED_KEYS), F.lit(False)), "compiled_graph")
        .when((c("language") == "cpp") & (c("subcategory") == "dispatch_key"), "c_dispatch").when(raw.contains("torch.library"), "c_dispatch")
        .when(raw.contains("register_") & raw.contains("_hook"), "python_wrapper").when(c("subcategory") == "hook_definition", "python_wrapper")
        .when(F.size("compliance_tags") > 0, "python_wrapper").otherwise(c("execution_level"))
    )
    return df.withColumn("execution_level", level)


COLLECTIVES = (r"\btorch\.distributed\.all_reduce\b", r"\btorch\.distributed\.all_gather\b", r"\btorch\.distributed\.broadcast\b", r"\btorch\.distributed\.barrier\b", r"\ball_reduce\s*\(", r"\ball_gather\s*\(")
PARAMETERS = (r"module\.parameters\s*\(", r"module\.named_parameters\s*\(", r"\.parameters\s*\(\s*\)")


def distributed_safety(df: DataFrame) -> DataFrame:
    raw = F.col("raw_text")
    first = lambda rules: F.coalesce(*(F.when(raw.rlike(r), F.regexp_extract(raw, r, 0)) for r in rules))
    t = df.withColumn("__sync", first(COLLECTIVES)).withColumn("__par", F.when(~raw.contains("_summon_full_params"), first(PARAMETERS)))
    sync, par, tagged = F.col("__sync"), F.col("__par"), F.size("compliance_tags") > 0
    level = F.when(sync.isNotNull(), "unsafe").when(par.isNotNull(), "conditional").otherwise("safe")
    note = F.when(sync.isNotNull(), F.concat(F.lit("distributed sync point '"), sync, F.lit("' blocks until every rank calls it"))).when(par.isNotNull(), F.concat(F.lit("parameters read through '"), par, F.lit("' may be one shard only under FSDP"))).otherwise("")
    return t.withColumns({"distributed_safety": F.when(tagged, level).otherwise(F.col("distributed_safety")), "distributed_safety_notes": F.when(tagged, note).otherwise(F.col("distributed_safety_notes"))}).drop("__sync", "__par")


def lifecycle(df: DataFrame) -> DataFrame:
    c = F.col
    name, src, sub = F.lower("entity_name"), c("source_file"), c("subcategory")
    phase = (
        F.when(name.contains("backward") | name.contains("grad"), "training_only").when(sub.isin("hook_definition", "hook_consumer") & name.contains("forward"), "inference_safe")
        .when(src.contains("torch/utils/data/"), "data_preparation").when(src.contains("torch/onnx/") | src.contains("torch/export/") | (sub == "torchscript"), "deployment")
        .when(sub.isin("dispatch_key", "profiler_hook"), "inference_safe").when(c("entity_type") == "test_case", "training_only")
        .when(F.size("compliance_tags") > 0, "inference_safe").otherwise(c("lifecycle_phase"))
    )
    return df.withColumn("lifecycle_phase", phase)


def export_survival(df: DataFrame) -> DataFrame:
    c = F.col
    sub = c("subcategory")
    vector = lambda statuses: F.create_map(*(F.lit(x) for pair in zip(dims.TARGETS, statuses) for x in pair))
    hook = sub == "hook_definition"
    rules = [(hook & c("entity_name").contains("state_dict"), dims.STATE_HOOK), (hook & c("entity_name").contains("forward"), dims.FORWARD_HOOK)]
    for name, code in dims.SURVIVAL.items():
        test = (c("entity_type") == "class") & (F.lower("qualified_name").contains("autograd") | (sub == "autograd_function")) if name == "autograd" else sub == name
        rules.append((test, code))
    new = None
    for test, code in rules:
        new = F.when(test, vector(code)) if new is None else new.when(test, vector(code))
    gate = (F.size("compliance_tags") > 0) | sub.isin(*dims.EXPORT_RELEVANT)
    return df.withColumn("export_survival", F.when(gate, F.coalesce(new.otherwise(F.lit(None)), c("export_survival"))).otherwise(c("export_survival")))


def confidence(df: DataFrame, deterministic: DataFrame | None = None, names: dict[str, list[str]] | None = None) -> DataFrame:
    """Boosts and defaults. ``deterministic``: a table of operator names in ``entity_name``."""
    names = dims.NAMES if names is None else names
    if deterministic is None:
        t = df.withColumn("__d", F.lit(False))
    else:
        known = deterministic.select(F.col("entity_name").alias("__n"), F.lit(True).alias("__k")).distinct()
        t = df.join(known, F.col("entity_name") == F.col("__n"), "left").withColumn("__d", F.coalesce("__k", F.lit(False))).drop("__n", "__k")
    tagged = F.size("compliance_tags") > 0
    ext = F.when(F.col("__d") | (F.col("entity_type") == "test_case") & tagged, F.greatest("extraction_confidence", F.lit(0.95))).otherwise(F.col("extraction_confidence"))
    mapped = F.when(F.col("__d"), F.greatest("mapping_confidence", F.lit(0.95))).otherwise(F.col("mapping_confidence"))
    why = F.col("mapping_rationale")
    first = F.when(F.col("entity_name").isin(*names), 0.8).when(why.contains("Tier-1") | why.contains("Tier-2"), 0.6).when(why.contains("Tier-3"), 0.4).otherwise(0.2)
    return t.withColumns({"extraction_confidence": ext, "mapping_confidence": F.when(tagged & (mapped == 0), first).otherwise(mapped)}).drop("__d")


def conflicts(df: DataFrame) -> DataFrame:
    """Warnings ``(id, entity_name, warning)`` for contradicting tags and phases."""
    has = lambda s: F.array_contains("compliance_tags", s)
    found = F.array_compact(F.array(F.when(has("eu_ai_act_art_15") & has("eu_ai_act_art_11"), "robustness_and_documentation"), F.when((F.col("lifecycle_phase") == "training_only") & has("eu_ai_act_art_11"), "training_only_and_documentation")))
    return df.select("id", "entity_name", F.explode(found).alias("warning"))


def annotate(df: DataFrame, deterministic: DataFrame | None = None) -> DataFrame:
    """All annotators in their fixed order."""
    for step in (hook_consumers, tag_articles, execution_level, distributed_safety, lifecycle, export_survival):
        df = df.transform(step)
    return confidence(df, deterministic)


# -- ratings by a model, consumed as tables ------------------------------------------------------------------


VALIDATED = "llm_mapping_validated"


def unsure(df: DataFrame, below: float = 0.7) -> DataFrame:
    """Tagged records whose mapping is unsure and not validated yet: what a model is asked about."""
    seen = F.coalesce(F.try_element_at("metadata", F.lit(VALIDATED)), F.lit(""))
    return df.where((F.col("mapping_confidence") < below) & (F.size("compliance_tags") > 0) & (F.lower(seen) != "true"))


def apply_ratings(df: DataFrame, ratings: DataFrame) -> DataFrame:
    """``ratings(record_id, tag, relevance, confidence, reason)``: direct ones raise the confidence and give the
    reason, indirect ones raise it to 0.7 of theirs, ``none`` (null too) takes the tag away, others only count as seen. A
    missing confidence is 0. Records with a rating are marked as validated, so that a later run passes over them."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))))
    kind = F.lower(F.coalesce("relevance", F.lit("none")))
    r = ratings.select("record_id", "tag", kind.alias("k"), c.alias("c"), "reason")
    g = r.groupBy("record_id").agg(
        F.collect_set(F.when(F.col("k") == "none", F.col("tag"))).alias("__gone"),
        F.max(F.when(F.col("k") == "direct", F.col("c")).when(F.col("k") == "indirect", 0.7 * F.col("c"))).alias("__up"),
        F.max_by("reason", F.when(F.col("k") == "direct", F.struct("c", "tag"))).alias("__why"),
    )
    t = df.join(g, df.id == g.record_id, "left")
    seen = F.map_concat(F.map_filter("metadata", lambda k, v: k != VALIDATED), F.create_map(F.lit(VALIDATED), F.lit("true")))
    return t.withColumns({
        "compliance_tags": F.when(F.col("__gone").isNull(), F.col("compliance_tags")).otherwise(F.filter("compliance_tags", lambda x: ~F.array_contains("__gone", x))),
        "mapping_confidence": F.greatest("mapping_confidence", F.coalesce("__up", F.lit(0.0))),
        "mapping_rationale": F.coalesce("__why", "mapping_rationale"),
        "metadata": F.when(F.col("record_id").isNull(), F.col("metadata")).otherwise(seen),
    }).drop("record_id", "__gone", "__up", "__why")


# The article that a commit's class speaks for.
COMMIT_TAGS = {
    "security_fix": "eu_ai_act_art_15",
    "determinism_change": "eu_ai_act_art_9",
    "deprecation": "eu_ai_act_art_11",
    "breaking_change": "eu_ai_act_art_11",
    "hook_change": "eu_ai_act_art_14",
    "data_handling": "eu_ai_act_art_10",
    "not_relevant": "",
}


def relabel_commits(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels(record_id, label)``: the label becomes the subcategory and its one tag replaces the others; one that is not
    relevant clears them. A label outside ``COMMIT_TAGS``, null included, changes nothing."""
    known = labels.where(F.col("label").isin(*COMMIT_TAGS)).groupBy(F.col("record_id").alias("__r")).agg(F.max("label").alias("__l"))
    t = df.join(known, F.col("id") == F.col("__r"), "left")
    tag = F.filter(F.array(F.try_element_at(F.create_map(*(F.lit(x) for kv in COMMIT_TAGS.items() for x in kv)), F.col("__l"))), lambda x: x != "")
    return t.withColumns({"compliance_tags": F.when(F.col("__l").isNull(), F.col("compliance_tags")).otherwise(tag), "subcategory": F.coalesce("__l", "subcategory")}).drop("__r", "__l")


def apply_article_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels(record_id, articles, docstring)``: articles like ``Art.15`` join the tags as a sorted set; the
    longer docstring wins."""
    t = df.join(labels.select(F.col("record_id").alias("__r"), F.col("articles").alias("__a"), F.col("docstring").alias("__d")), F.col("id") == F.col("__r"), "left")
    found = F.transform(F.filter(F.coalesce("__a", _none()), lambda a: a.rlike(r"Art\.?\s*[0-9]+")), lambda a: F.concat(F.lit("eu_ai_act_art_"), F.regexp_extract(a, r"([0-9]+)", 1)))
    tags = F.when(F.col("__r").isNull(), F.col("compliance_tags")).otherwise(F.array_sort(F.array_union("compliance_tags", found)))
    doc = F.when(F.length(F.coalesce("__d", F.lit(""))) > F.length("docstring"), F.col("__d")).otherwise(F.col("docstring"))
    return t.withColumns({"compliance_tags": tags, "docstring": doc}).drop("__r", "__a", "__d")
