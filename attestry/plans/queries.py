"""The queries over the test tables, each with its SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, exprs
from ..operators import annotate, audit, consent, drift, fairness, organize, search, snapshots, triples
from .entities import PART, parts, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tags_text(c: str = "compliance_tags"):
    return F.array_join(c, ",")


# -- the annotators as SQL over the part records ---------------------------------------------------------------


def _list(tags) -> str:
    return "[" + ", ".join(q(t) for t in tags) + "]::varchar[]"


def _names_case(column: str) -> str:
    used = ("register_forward_hook", "DataLoader", "predict", "save", "manual_seed", "make_private", "grad", "state_dict")
    return f"case {column} " + " ".join(f"when {q(n)} then {_list(dims.NAMES[n])}" for n in used) + " else []::varchar[] end"


_PHRASES_SQL = "flatten([" + ", ".join(f"case when contains(lower(docstring), {q(p)}) then {_list(t)} else []::varchar[] end" for p, t in dims.PHRASES) + "])"


def _code(statuses: tuple[str, ...]) -> str:
    """The statuses' first letters, as one value in SQL."""
    return "".join(s[0] for s in statuses)


_NAME = "lower(entity_name)"


def _like_any(words: str) -> str:
    return "(" + " or ".join(f"contains({_NAME}, {q(w)})" for w in words.split()) + ")"


def _decides() -> str:
    return "(" + " or ".join(f"{_NAME} = '{k}' or starts_with({_NAME}, '{k}_') or ends_with({_NAME}, '_{k}')" for k in ("predict", "classify", "score", "decision")) + ")"


_TIER2 = f"""list_distinct_ordered(flatten([
  case when subcategory = 'autograd_extension' then {_list(["eu_ai_act_art_15"])} else [] end, case when subcategory = 'hook_consumer' then {_list(["eu_ai_act_art_61"])} else [] end,
  case when subcategory = 'hook_definition' then {_list(["eu_ai_act_art_14", "eu_ai_act_art_12"])} else [] end, case when subcategory = 'override_protocol' then {_list(["eu_ai_act_art_14"])} else [] end,
  case when subcategory = 'data_loading' then {_list(["gdpr_art_5", "eu_ai_act_art_10"])} else [] end,
  case when entity_type in ('function', 'method') and {_decides()} then {_list(["gdpr_art_22", "eu_ai_act_art_13"])} else [] end,
  case when {_like_any('privacy _private anonymi pseudonym dp_optimizer grad_sample noise_multi per_sample')} then {_list(["gdpr_art_25"])} else [] end,
  case when {_like_any('encrypt decrypt ssl_ _ssl tls_ _tls secure_ _secure hmac hash_data hash_tensor checksum verify_key certif crypto')} then {_list(["gdpr_art_32"])} else [] end]))"""


def _ordered(x: str) -> str:
    """First occurrences of a list, in order."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def _records(upto: str = "conf") -> str:
    """CTEs ``r0`` .. up to the named annotator, ending in ``rec``."""
    tier2 = _TIER2.replace("list_distinct_ordered(", "(", 1)
    hookre = f"(?:^|[.\\s])({'|'.join(sorted(dims.HOOKS))})\\s*\\("
    defre = f"def\\s+({'|'.join(sorted(dims.HOOKS))})\\s*\\("
    ctes = [
        ("e0", PART),
        ("e1", f"""select *, case when subcategory = 'hook_consumer' then 1 when raw_text <> '' and subcategory <> 'hook_definition'
   and len(list_filter(regexp_extract_all(raw_text, '{hookre}', 1), lambda c: not list_contains(regexp_extract_all(raw_text, '{defre}', 1), c))) > 0 then 2 else 0 end hit from e0"""),
        ("hook", f"""select * exclude (hit, subcategory, mapping_confidence), case when hit = 2 then 'hook_consumer' else subcategory end subcategory, case when hit > 0 then {_list(["eu_ai_act_art_61"])} else []::varchar[] end tags0,
   case when hit > 0 then greatest(mapping_confidence, 0.85) else mapping_confidence end conf0 from e1"""),
        ("t1", f"select *, {_names_case('entity_name')} a1, {tier2} a2, {_PHRASES_SQL} a3 from hook"),
        ("t2", "select *, list_concat(tags0, a1, a2, a3) allt from t1"),
        ("tag", f"""select *, {_ordered('allt')} tags, greatest(conf0, case when len(a1) > 0 then 0.8 else 0 end, case when len(a2) > 0 then 0.85 else 0 end, case when len(a3) > 0 then 0.5 else 0 end) conf1 from t2"""),
        ("lvl", """select *, case when subcategory = 'graph_break_reason' then 'compiled_graph' when contains(source_file, '_dynamo') then 'compiled_graph' when entity_name in ('CompositeExplicitAutograd', 'FuncTorchBatched') then 'compiled_graph'
   when language = 'cpp' and subcategory = 'dispatch_key' then 'c_dispatch' when contains(raw_text, 'torch.library') then 'c_dispatch' when contains(raw_text, 'register_') and contains(raw_text, '_hook') then 'python_wrapper'
   when subcategory = 'hook_definition' then 'python_wrapper' when len(tags) > 0 then 'python_wrapper' else '' end level from tag"""),
        ("safe", r"""select *, case when len(tags) = 0 then '' when regexp_matches(raw_text, '\btorch\.distributed\.(all_reduce|all_gather|broadcast|barrier)\b|\b(all_reduce|all_gather)\s*\(') then 'unsafe'
   when not contains(raw_text, '_summon_full_params') and regexp_matches(raw_text, 'module\.(named_)?parameters\s*\(|\.parameters\s*\(\s*\)') then 'conditional' else 'safe' end safety from lvl"""),
        ("life", """select *, case when contains(lower(entity_name), 'backward') or contains(lower(entity_name), 'grad') then 'training_only' when subcategory in ('hook_definition', 'hook_consumer') and contains(lower(entity_name), 'forward') then 'inference_safe'
   when contains(source_file, 'torch/utils/data/') then 'data_preparation' when contains(source_file, 'torch/onnx/') or contains(source_file, 'torch/export/') or subcategory = 'torchscript' then 'deployment'
   when subcategory in ('dispatch_key', 'profiler_hook') then 'inference_safe' when entity_type = 'test_case' then 'training_only' when len(tags) > 0 then 'inference_safe' else '' end phase from safe"""),
        ("surv", f"""select *, case when not (len(tags) > 0 or subcategory in ({', '.join(map(q, dims.EXPORT_RELEVANT))})) then '' when subcategory = 'hook_definition' and contains(entity_name, 'state_dict') then '{_code(dims.STATE_HOOK)}'
   when subcategory = 'hook_definition' and contains(entity_name, 'forward') then '{_code(dims.FORWARD_HOOK)}' when subcategory = 'dispatch_key' then '{_code(dims.SURVIVAL['dispatch_key'])}'
   when entity_type = 'class' and (contains(lower(qualified_name), 'autograd') or subcategory = 'autograd_function') then '{_code(dims.SURVIVAL['autograd'])}' """
         + " ".join(f"when subcategory = '{k}' then '{_code(v)}'" for k, v in dims.SURVIVAL.items() if k not in ("dispatch_key", "autograd")) + " else '' end survival from life"),
        ("rec", """select * exclude (extraction_confidence), case when entity_type = 'test_case' and len(tags) > 0 then greatest(extraction_confidence, 0.95) else extraction_confidence end ext,
   case when len(tags) > 0 and conf1 = 0 then 0.2 else conf1 end conf from surv"""),
    ]
    names = [n for n, _ in ctes]
    keep = ctes[: names.index(upto) + 1] if upto in names else ctes
    return "with " + ",\n".join(f"{n} as ({s})" for n, s in keep) + "\n"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.annotate(parts(spark, sf_dir))


def _tagged(spark, sf_dir):
    return parts(spark, sf_dir).transform(annotate.hook_consumers).transform(annotate.tag_articles)


@query(_records("hook") + "select id, subcategory, array_to_string(tags0, ',') tags, conf0 conf from hook")
def hook_consumers(spark, sf_dir):
    return annotate.hook_consumers(parts(spark, sf_dir)).select("id", "subcategory", tags_text().alias("tags"), F.col("mapping_confidence").alias("conf"))


@query(_records("tag") + "select id, array_to_string(a1, ',') tags from tag where len(a1) > 0")
def tag_tier1(spark, sf_dir):
    t = parts(spark, sf_dir).withColumn("t", annotate.lookup(dims.NAMES, F.col("entity_name")))
    return t.where(F.size("t") > 0).select("id", tags_text("t").alias("tags"))


@query(_records("tag") + f"select id, array_to_string({_ordered('a2')}, ',') tags from tag where len(a2) > 0")
def tag_tier2(spark, sf_dir):
    t = annotate.hook_consumers(parts(spark, sf_dir)).withColumn("t", annotate.structural_tags())
    return t.where(F.size("t") > 0).select("id", tags_text("t").alias("tags"))


@query(f"select doc_id, array_to_string({_ordered('a3')}, ',') tags from (select doc_id, flatten([case when contains(lower(docstring), 'the') then ['eu_ai_act_art_9'] else [] end, case when contains(lower(docstring), 'license') then ['gdpr_art_5', 'eu_ai_act_art_12'] else [] end, case when contains(lower(docstring), 'token') then ['gdpr_art_32', 'gdpr_art_5'] else [] end]) a3 from (select doc_id, coalesce(text, '') docstring from documents)) where len(a3) > 0")
def tag_tier3(spark, sf_dir):
    phrases = [("the", ["eu_ai_act_art_9"]), ("license", ["gdpr_art_5", "eu_ai_act_art_12"]), ("token", ["gdpr_art_32", "gdpr_art_5"])]
    tags, _ = annotate.phrase_tags(phrases, F.coalesce("text", F.lit("")))
    t = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(tags).alias("t"))
    return t.where(F.size("t") > 0).select("doc_id", tags_text("t").alias("tags"))


@query(_records("tag") + "select id, array_to_string(tags, ',') tags, conf1 conf from tag")
def tag_merge(spark, sf_dir):
    return _tagged(spark, sf_dir).select("id", tags_text().alias("tags"), F.col("mapping_confidence").alias("conf"))


@query(_records("lvl") + "select level, count(*) n from lvl group by 1")
def exec_level(spark, sf_dir):
    return annotate.execution_level(_tagged(spark, sf_dir)).groupBy(F.col("execution_level").alias("level")).agg(F.count("*").alias("n"))


@query(_records("safe") + "select id, safety from safe")
def dist_safety(spark, sf_dir):
    return annotate.distributed_safety(_tagged(spark, sf_dir)).select("id", F.col("distributed_safety").alias("safety"))


@query(_records("life") + "select id, phase from life")
def lifecycle(spark, sf_dir):
    return annotate.lifecycle(_tagged(spark, sf_dir)).select("id", F.col("lifecycle_phase").alias("phase"))


@query(_records() + "select id, ext, conf from rec")
def confidence_default(spark, sf_dir):
    return records(spark, sf_dir).select("id", F.col("extraction_confidence").alias("ext"), F.col("mapping_confidence").alias("conf"))


@query(_records() + "select id, case when list_contains(tags, 'eu_ai_act_art_15') and list_contains(tags, 'eu_ai_act_art_11') then 'robustness_and_documentation' end warning from rec where warning is not null union all select id, 'training_only_and_documentation' from rec where phase = 'training_only' and list_contains(tags, 'eu_ai_act_art_11')")
def conflict_warnings(spark, sf_dir):
    return annotate.conflicts(records(spark, sf_dir)).select("id", "warning")


_SURV = "select id, unnest(['onnx', 'exported_program', 'torchscript', 'torch_compile', 'distributed_checkpoint']) target, unnest(string_split(survival, '')) s from rec where survival <> ''"


@query(_records() + f"select target, count(*) filter (where s = 'y') yes, count(*) filter (where s = 'n') \"no\", count(*) filter (where s = 'p') partial from ({_SURV}) group by 1")
def survival_summary(spark, sf_dir):
    return organize.survival_counts(records(spark, sf_dir))


@query(_records() + f"select target, count(*) filter (where s = 'y') yes, count(*) filter (where s = 'n') \"no\", count(*) filter (where s = 'p') partial from ({_SURV}) group by 1")
def survival_matrix(spark, sf_dir):
    return organize.survival_matrix(records(spark, sf_dir))


@query(_records() + "select id, conf from rec where survival <> '' order by conf desc, input_seq limit 50")
def matrix_top50(spark, sf_dir):
    t = organize.top(records(spark, sf_dir).where(F.size("export_survival") > 0), 50, F.desc("mapping_confidence"), "input_seq")
    return t.select("id", F.col("mapping_confidence").alias("conf"))


@query(_records() + "select id, len(tags) n from rec where len(tags) > 0 order by n desc, entity_name, input_seq limit 30")
def matrix_top30(spark, sf_dir):
    t = records(spark, sf_dir).where(F.size("compliance_tags") > 0).withColumn("n", F.size("compliance_tags").cast("long"))
    return organize.top(t, 30, F.desc("n"), "entity_name", "input_seq").select("id", "n")


@query(_records() + "select id, conf from rec where list_contains(tags, 'eu_ai_act_art_14') order by conf desc, input_seq limit 40")
def article_top40(spark, sf_dir):
    t = organize.top(records(spark, sf_dir).where(F.array_contains("compliance_tags", "eu_ai_act_art_14")), 40, F.desc("mapping_confidence"), "input_seq")
    return t.select("id", F.col("mapping_confidence").alias("conf"))


# -- statistics ------------------------------------------------------------------------------------------------


@query("select lang as value, count(*) n from documents where lang <> '' group by 1")
def stat_count_by_field(spark, sf_dir):
    return organize.count_by(table(spark, sf_dir, "documents"), "lang")


@query(_records() + "select count(*) total, count(*) filter (where len(tags) > 0) tagged, round(count(*) filter (where len(tags) > 0) / count(*), 4) density from rec")
def stat_density(spark, sf_dir):
    return organize.density(records(spark, sf_dir))


@query(_records() + "select tag, count(*) n from (select unnest(tags) tag from rec) group by 1")
def stat_per_tag(spark, sf_dir):
    return organize.per_tag(records(spark, sf_dir))


@query(_records() + "select array_to_string(string_split(module_path, '.')[1:2], '.') as \"module\", count(*) n from rec where len(tags) > 0 and module_path <> '' group by 1")
def stat_per_module(spark, sf_dir):
    return organize.per_module(records(spark, sf_dir))


@query(_records() + "select case when module_path <> '' then string_split(module_path, '.')[1] else string_split(source_file, '/')[1] end as \"module\", count(*) total, count(*) filter (where len(tags) > 0) tagged, round(count(*) filter (where len(tags) > 0) / count(*), 4) density from rec group by 1")
def stat_module_density(spark, sf_dir):
    return organize.module_density(records(spark, sf_dir))


@query("select b.bin, coalesce(n, 0) n from (select cast(unnest(range(5)) as int) bin) b left join (select cast(least(greatest(floor(l_discount * 10 * 5 + 1e-9), 0), 4) as int) bin, count(*) n from lineitem group by 1) c using (bin)")
def stat_conf_histogram(spark, sf_dir):
    return organize.histogram(table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("x")), "x")


@query("select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 20")
def stat_top20(spark, sf_dir):
    return organize.top(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), 20, F.desc("p_retailprice"), "p_partkey")


_INDEX = " union all ".join(f"select '{d}' dimension, {c} as \"key\", id from rec" for d, c in (("entity_name", "entity_name"), ("source_file", "source_file"), ("language", "language"), ("entity_type", "entity_type"), ("subcategory", "subcategory"), ("lifecycle_phase", "phase"), ("execution_level", "level"), ("compliance_tags", "unnest(tags)")))


@query(_records() + f"select dimension, \"key\", count(*) n from ({_INDEX}) where \"key\" <> '' group by 1, 2")
def index_dimensions(spark, sf_dir):
    return organize.index_sizes(records(spark, sf_dir))


_GAP = ", ".join(f"('{a}')" for a in dims.ARTICLES)


@query(_records() + f"select a.tag, coalesce(n, 0) n from (values {_GAP}) a(tag) left join (select tag, count(*) n from (select unnest(tags) tag from rec) group by 1) c using (tag)")
def article_gaps(spark, sf_dir):
    return organize.gaps(records(spark, sf_dir))


# -- fixed graph queries -----------------------------------------------------------------------------------------


@query(_records() + "select tag, count(distinct id) n, round(avg(conf), 6) mean_confidence from (select id, conf, unnest(tags) tag from rec) group by 1")
def q_coverage_matrix(spark, sf_dir):
    return triples.coverage_matrix(records(spark, sf_dir)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(_records() + "select id, entity_name, entity_type, conf mapping_confidence from rec where list_contains(tags, 'eu_ai_act_art_14')")
def q_art14_gap(spark, sf_dir):
    return triples.article_gap(records(spark, sf_dir)).drop("mapping_rationale")


@query("select concat('p', p_partkey) id, p_brand entity_name, case when p_size % 2 = 0 then 'true' else 'false' end determinism from part where p_size % 3 = 0")
def q_determinism(spark, sf_dir):
    flag = F.when(F.col("p_size") % 2 == 0, "true").otherwise("false")
    meta = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("deterministic_enforceable"), flag)).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    t = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_brand").alias("entity_name"), F.lit("").alias("subcategory"), F.lit("").alias("source_file"), F.lit(1.0).alias("extraction_confidence"), F.lit(0.0).alias("mapping_confidence"), meta.alias("metadata"))
    return triples.determinism_census(t).select("id", "entity_name", "determinism")


@query(_records() + "select id, entity_name, tag, source_file from (select *, unnest(tags) tag from rec where survival <> '' and substr(survival, 4, 1) <> 'y') where starts_with(tag, 'eu_ai_act')")
def q_export_gaps(spark, sf_dir):
    return triples.export_gaps(records(spark, sf_dir))


@query(_records() + "select tag, count(distinct id) n from (select id, unnest(tags) tag from rec where entity_type = 'test_case') where starts_with(tag, 'eu_ai_act') group by 1")
def q_test_coverage(spark, sf_dir):
    return triples.test_coverage(records(spark, sf_dir))


@query(_records() + "select id, entity_name, source_file from rec where subcategory = 'hook_definition' and substr(survival, 4, 1) = 'y'")
def q_hooks_surviving(spark, sf_dir):
    return triples.hooks_surviving(records(spark, sf_dir))


@query(_records() + "select tag, count(distinct id) n from (select id, unnest(tags) tag from rec where conf >= 0.8) where starts_with(tag, 'eu_ai_act') group by 1")
def q_high_conf(spark, sf_dir):
    return triples.high_confidence(records(spark, sf_dir))


@query(_records() + "select count(*) > 0 answer from rec where list_contains(tags, 'eu_ai_act_art_14')")
def q_ask(spark, sf_dir):
    return triples.ask(records(spark, sf_dir).where(F.array_contains("compliance_tags", "eu_ai_act_art_14")))


_B = triples.BASE
_TRIPLES = f"""
u as (select *, concat('{_B}', id) s, round(ext, 4) e4, round(conf, 4) c4 from rec),
v as (select id, s, unnest(['onnx', 'exported_program', 'torchscript', 'torch_compile', 'distributed_checkpoint']) target, unnest(string_split(survival, '')) y from u where survival <> ''),
w as (select s, concat(s, '_survival_', target) n, target, case y when 'y' then 'yes' when 'n' then 'no' else 'partial' end st from v)
select p, count(*) n from (select distinct s, p, o from (
  select s, 'type' p, 'E' o from u union all select s, 'name', entity_name from u where entity_name <> '' union all select s, 'entityType', entity_type from u where entity_type <> ''
  union all select s, 'subcategory', subcategory from u where subcategory <> '' union all select s, 'language', language from u where language <> '' union all select s, 'sourceFile', source_file from u where source_file <> ''
  union all select s, 'modulePath', module_path from u where module_path <> '' union all select s, 'qualifiedName', qualified_name from u where qualified_name <> '' union all select s, 'startLine', cast(start_line as varchar) from u where start_line <> 0
  union all select s, 'docstring', docstring from u where docstring <> '' union all select s, 'lifecyclePhase', phase from u where phase <> '' union all select s, 'executionLevel', level from u where level <> ''
  union all select s, 'distributedSafety', safety from u where safety <> '' union all select s, 'extractionConfidence', cast(e4 as varchar) from u union all select s, 'mappingConfidence', cast(c4 as varchar) from u
  union all select s, 'hasComplianceTag', unnest(tags) from u union all select s, 'hasExportSurvival', n from w union all select n, 'type', 'S' from w union all select n, 'exportFormat', target from w union all select n, 'survivalStatus', st from w)) group by 1"""


@query(_records() + "," + _TRIPLES)
def rdf_triples(spark, sf_dir):
    t = triples.triples(records(spark, sf_dir)).where("p <> 'mappingRationale'")
    return t.groupBy("p").agg(F.count("*").alias("n"))


@query(_records() + "select tag, id from (select *, row_number() over (partition by tag, qualified_name, case when qualified_name = '' then id end order by conf desc, input_seq) rn from (select *, unnest(tags) tag from rec)) where rn = 1")
def md_best_per_qname(spark, sf_dir):
    return organize.best_per_name(records(spark, sf_dir)).select("tag", "id")


# -- expressions -------------------------------------------------------------------------------------------------


@query("select p_partkey, substr(sha256(concat_ws(':', p_name, p_brand, p_type, cast(p_size as varchar), 'k', 's')), 1, 20) id from part")
def stable_id(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "part").select("p_partkey", exprs.stable_id(c("p_name"), c("p_brand"), c("p_type"), c("p_size"), F.lit("k"), F.lit("s")).alias("id"))


@query("""select page_id, regexp_replace(regexp_replace(url, '\\.[^./]+$', ''), '/', '.', 'g') "module", array_to_string(list_slice(string_split(url, '/'), -2, -1), '/') short, case when n >= .8 then 'high' when n >= .6 then 'medium' when n >= .4 then 'low' else 'speculative' end label from (select *, (page_id % 10) / 10 n from pages)""")
def path_expressions(spark, sf_dir):
    t = table(spark, sf_dir, "pages")
    return t.select("page_id", exprs.module_path(F.col("url")).alias("module"), exprs.short_path(F.col("url")).alias("short"), exprs.confidence_label((F.col("page_id") % 10) / 10).alias("label"))


@query("select page_id, substr(regexp_replace(regexp_replace(url, '[\\x00-\\x1f\\x7f]', '', 'g'), '[^a-zA-Z0-9._-]', '_', 'g'), 1, 128) safe from pages")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", exprs.safe_name(F.col("url")).alias("safe"))


@query("select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as bigint) top, round(-list_sum(list_transform(p, lambda x: greatest(x, 1e-9) * ln(greatest(x, 1e-9)))), 6) entropy, round(list_sum(list_slice(list_reverse_sort(p), 1, 3)), 6) top3 from (select *, list_transform(e, lambda x: x / list_sum(e)) p from (select *, list_transform(embedding, lambda x: exp(cast(x as double) - list_max(embedding))) e from embeddings))")
def softmax_expressions(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", exprs.softmax(F.col("embedding")).alias("p"))
    return t.select("vec_id", exprs.argmax(F.col("embedding")).cast("long").alias("top"), F.round(exprs.entropy(F.col("p")), 6).alias("entropy"), F.round(exprs.top_mass(F.col("p")), 6).alias("top3"))


@query()
def chunk_paragraphs(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(exprs.pack_paragraphs(F.coalesce("text", F.lit("")), by="\n")).alias("chunk", "text"))
    return t.select("doc_id", "chunk", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5"))


@query("select page_id, len(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)) n_tags, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) n_links from pages")
def directive_extract(spark, sf_dir):
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(1))).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", n(r"<([a-z0-9]+)[ >]").alias("n_tags"), n('href="([^"]*)"').alias("n_links"))


@query("select doc_id, case when contains(h, 'MIT') then 'MIT' when contains(h, 'Apache') then 'Apache-2.0' when contains(h, 'BSD') then 'BSD' when contains(h, 'GPL') then 'GPL' else 'unknown' end license from (select doc_id, substr(coalesce(text, ''), 1, 500) h from documents)")
def license_class(spark, sf_dir):
    from ..sources.extract import license_of

    return table(spark, sf_dir, "documents").select("doc_id", license_of(F.coalesce("text", F.lit(""))).alias("license"))


@query("select p_partkey, trim(string_split_regex(concat(p_brand, ' >= ', cast(p_size as varchar)), '[>=<!\\[]')[1]) dep from part")
def dep_split(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", exprs.dependency(F.concat("p_brand", F.lit(" >= "), F.col("p_size").cast("string"))).alias("dep"))


# -- dedup -------------------------------------------------------------------------------------------------------


@query("select doc_id, rn from (select doc_id, row_number() over (partition by md5(coalesce(text, '')) order by doc_id) rn from documents)")
def dedup_rank(spark, sf_dir):
    from ..schema import with_defaults

    t = table(spark, sf_dir, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("source_file"), F.col("doc_id").cast("string").alias("raw_text"), F.col("doc_id").alias("input_seq"))
    return organize.ranked(with_defaults(t)).select(F.col("raw_text").cast("long").alias("doc_id"), F.col("rn").cast("long").alias("rn"))


_D = """with e as (select event_id, concat('u', user_id) source_file, event_type entity_name, case when event_id % 3 = 0 then '' else concat('d', event_id) end docstring, case when event_id % 5 = 0 then concat('s', event_id) else '' end signature,
  round(value, 2) conf, [concat('t', event_id % 7), concat('t', event_id % 4)] tags from events),
g as (select *, case when docstring <> '' then 1 else 0 end + case when signature <> '' then 1 else 0 end + case when conf <> 0 then 1 else 0 end rich from e),
s as (select source_file, entity_name, list(docstring order by rich desc, event_id) ds, list(signature order by rich desc, event_id) ss, max(conf) conf, list(tags order by rich desc, event_id) tl, count(*) n from g group by 1, 2)
select source_file, entity_name, coalesce(list_filter(ds, lambda x: x <> '')[1], '') docstring, coalesce(list_filter(ss, lambda x: x <> '')[1], '') signature, conf mapping_confidence,
  array_to_string(list_reduce(tl, lambda a, x: list_concat(a, list_filter(x, lambda y, i: not list_contains(a, y) and list_position(x, y) = i))), ',') tags from s"""


@query(_D)
def dedup_merge(spark, sf_dir):
    from ..schema import with_defaults

    c = F.col
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("source_file"), c("event_type").alias("entity_name"), F.when(c("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("d"), "event_id")).alias("docstring"),
        F.when(c("event_id") % 5 == 0, F.concat(F.lit("s"), "event_id")).otherwise("").alias("signature"), F.round("value", 2).alias("mapping_confidence"),
        F.array(F.concat(F.lit("t"), c("event_id") % 7), F.concat(F.lit("t"), c("event_id") % 4)).alias("compliance_tags"), c("event_id").alias("input_seq"),
    )
    return organize.dedup(with_defaults(e)).select("source_file", "entity_name", "docstring", "signature", "mapping_confidence", tags_text().alias("tags"))


# -- cross references ----------------------------------------------------------------------------------------------


@query("select distinct d.doc_id, b.item_id from documents d, benchmark b where contains(d.text, b.text) and length(b.text) >= 8")
def xref_name_match(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    b = table(spark, sf_dir, "benchmark").where(F.length("text") >= 8).select("item_id", F.col("text").alias("name")).distinct()
    # A word strictly inside a passage has white space on both sides wherever the passage occurs, so it is a token
    # of the document; the first and the last word need not be. Passages without one are compared with every text.
    inner = F.regexp_extract_all("name", F.lit(r"(?<=\s)\S+(?=\s)"), F.lit(0))
    b = b.withColumn("token", F.array_max(F.transform(inner, lambda t: F.struct(F.length(t), t.alias("token"))))["token"])
    seen = d.select(F.col("id").alias("doc_id"), F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("token"))
    pairs = seen.join(b, "token").select("doc_id", "item_id", "name").distinct().join(d.withColumnRenamed("id", "doc_id"), "doc_id")
    whole = d.withColumnRenamed("id", "doc_id").join(b.where("token is null"), F.contains("text", "name"))
    found = pairs.where(F.col("text").contains(F.col("name"))).select("doc_id", "item_id")
    return found.union(whole.select("doc_id", "item_id")).distinct()


_TAIL = "list_slice(string_split(p_name, ' '), -1, -1)[1]"


@query("select c_nationkey, count(*) n, min(c_custkey) as \"first\", max(c_custkey) as \"last\" from customer group by 1 having count(*) > 1")
def xref_co_implements(spark, sf_dir):
    return organize.co_members(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey")


@query("select c_nationkey, c_custkey from customer where c_nationkey in (select c_nationkey from customer group by 1 having count(*) > 1)")
def xref_co_rows(spark, sf_dir):
    return organize.co_member_rows(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey")


def _nation_edges(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("source"), F.when(F.col("n_nationkey") % 6 == 0, F.concat(F.lit("{{"), "r_name", F.lit("}}"))).otherwise(F.col("r_name")).alias("target"))


_E = "with e as (select n_name source, case when n_nationkey % 6 = 0 then '{{' || r_name || '}}' else r_name end target from nation join region on n_regionkey = r_regionkey) "


@query(_E + "select distinct node from (select source node from e where not contains(target, '{{') union all select target from e where not contains(target, '{{')) where node <> ''")
def xref_nodes(spark, sf_dir):
    return organize.nodes(_nation_edges(spark, sf_dir))


@query(_E + "select node, cast(sum(o) as bigint) n_out, cast(sum(i) as bigint) n_in from (select source node, 1 o, 0 i from e union all select target, 0, 1 from e) group by 1")
def xref_adjacency(spark, sf_dir):
    return organize.degrees(_nation_edges(spark, sf_dir))


# -- validation ----------------------------------------------------------------------------------------------------

_RULES = [
    ("subcategory <> subcategory or id = ''", "error"), ("source_file = ''", "error"), ("entity_name = ''", "error"), ("entity_type = ''", "error"), ("raw_text = ''", "info"), ("length(raw_text) > 5000", "warning"),
    ("ext < 0 or ext > 1", "warning"), ("conf < 0 or conf > 1", "warning"), (f"language <> '' and language not in ({', '.join(map(q, dims.LANGUAGES))})", "warning"),
    (f"entity_type <> '' and entity_type not in ({', '.join(map(q, dims.ENTITY_TYPES))})", "warning"), ("docstring = ''", "info"), ("len(tags) = 0", "info"),
]
_ISSUES = " union all ".join(f"select id record_id, {i} rule, '{level}' as \"level\" from rec where {test}" for i, (test, level) in enumerate(_RULES))


@query(_records() + f"select record_id, rule, \"level\" from ({_ISSUES})")
def validate_issues(spark, sf_dir):
    return organize.issues(records(spark, sf_dir)).select("record_id", "rule", "level")


@query(_records() + f"select \"level\", count(*) n from ({_ISSUES}) group by 1")
def validate_counts(spark, sf_dir):
    return organize.issue_counts(organize.issues(records(spark, sf_dir)))


@query("select cast(l_orderkey as varchar) record_id, input_seq from (select l_orderkey, l_orderkey * 10 + l_linenumber input_seq, row_number() over (partition by l_orderkey order by l_linenumber) rn from lineitem) where rn > 1")
def validate_dup_ids(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("input_seq"))
    return organize.duplicate_ids(t)


# -- consent and classes ---------------------------------------------------------------------------------------------


def _registry(spark, sf_dir):
    """A registry that knows nothing of every eleventh customer, so that reads of unknown subjects occur."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 11 <> 0")
    return c.select(F.col("c_custkey").alias("subject_id"), (F.col("c_custkey") % 7 != 0).alias("consent"), F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("billing"))).otherwise(F.array(F.lit("billing"), F.lit("training"))).alias("purposes"))


def _reads(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("subject_id"))


_LOG = """with log as (select o_orderkey, o_custkey subject_id, case when o_custkey % 11 = 0 or o_custkey % 7 = 0 then 'consent_withdrawn' when o_custkey % 5 = 0 then 'purpose_not_listed' else 'consent_granted' end reason from orders),
l as (select *, case when reason = 'consent_granted' then 'granted' else 'denied' end status from log) """


@query(_LOG + "select o_orderkey, subject_id, status, reason from l")
def consent_log(spark, sf_dir):
    return consent.access_log(_reads(spark, sf_dir), _registry(spark, sf_dir), "training")


@query(_LOG + "select subject_id, o_orderkey from l where status = 'granted'")
def consent_granted(spark, sf_dir):
    return consent.granted(_reads(spark, sf_dir), _registry(spark, sf_dir), "training")


@query(_LOG + "select subject_id, o_orderkey from l where status = 'denied'")
def consent_denied(spark, sf_dir):
    return consent.denied(_reads(spark, sf_dir), _registry(spark, sf_dir), "training")


@query(_LOG + "select count(*) filter (where status = 'granted') granted, count(*) filter (where status = 'denied') denied from l")
def consent_summary(spark, sf_dir):
    return consent.summary(consent.access_log(_reads(spark, sf_dir), _registry(spark, sf_dir), "training"))


@query(_LOG + "select cast(least(floor(o_orderkey / 50), 9) as bigint) bucket, count(*) filter (where status = 'granted') granted, count(*) filter (where status = 'denied') denied from l group by 1")
def consent_buckets(spark, sf_dir):
    return consent.per_bucket(consent.access_log(_reads(spark, sf_dir), _registry(spark, sf_dir), "training"), "o_orderkey")


@query("select cast(sum(n) as bigint) n_samples, count(*) n_classes, round(max(n) / greatest(min(n), 1), 6) imbalance, max(n) / greatest(min(n), 1) > 5.0 warning from (select event_type, count(*) n from events group by 1)")
def class_profile(spark, sf_dir):
    return consent.class_profile(table(spark, sf_dir, "events"), "event_type")


@query("select round(case when count(*) < 2 then 1.0 else max(n) / min(n) end, 6) ratio, case when count(*) < 2 then 1.0 else max(n) / min(n) end > 3.0 imbalanced from (select label, count(*) n from embeddings group by 1)")
def imbalance_ratio(spark, sf_dir):
    return consent.imbalance(table(spark, sf_dir, "embeddings"), "label")


# -- fairness --------------------------------------------------------------------------------------------------------


def _judged(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return table(spark, sf_dir, "labels").join(d, "doc_id").withColumn("epoch", F.col("doc_id") % 8).withColumn("batch", F.floor(F.col("doc_id") / 100))


_J = "with j as (select l.*, lang, doc_id % 8 epoch, cast(floor(doc_id / 100) as bigint) batch from labels l join documents d using (doc_id)) "


@query(_J + "select count(*) n_groups, round(case when count(*) >= 2 then max(r) - min(r) end, 9) disparity from (select lang, avg(toxic) r from j group by 1)")
def demographic_parity(spark, sf_dir):
    return fairness.parity(_judged(spark, sf_dir), "toxic", "lang")


@query(_J + "select round(max(a) - min(a), 6) tpr_gap, round(max(b) - min(b), 6) fpr_gap from (select lang, count(*) filter (where toxic = 1 and quality = 1) / (count(*) filter (where quality = 1) + 1e-9) a, count(*) filter (where toxic = 1 and quality = 0) / (count(*) filter (where quality = 0) + 1e-9) b from j group by 1)")
def equalized_odds(spark, sf_dir):
    return fairness.equalized_odds(_judged(spark, sf_dir), "toxic", "quality", "lang")


@query(_J + "select epoch, round(d, 9) disparity, 0.1 threshold, case when d is null then 'skipped' when round(d, 9) > 0.1 then 'failed' else 'passed' end status from (select epoch, case when count(*) >= 2 then max(r) - min(r) end d from (select epoch, lang, avg(toxic) r from j group by 1, 2) group by 1)")
def fairness_by_epoch(spark, sf_dir):
    return fairness.gate(_judged(spark, sf_dir), "epoch", "toxic", "lang")


@query(_J + """, b as (select distinct batch from j), g as (select distinct lang from j), c as (select b.batch, g.lang, count(j.doc_id) n, count(*) filter (where toxic = 1) p from b cross join g left join j on j.batch = b.batch and j.lang = g.lang group by 1, 2),
  u as (select batch, lang, sum(p) over w p, sum(n) over w n from c window w as (partition by lang order by batch)), d as (select batch, case when count(*) >= 2 then max(p / n) - min(p / n) else 0.0 end disparity from u where n > 0 group by 1)
  select batch, round(disparity, 9) disparity, coalesce(batch >= (select min(batch) from d where disparity > 0.1), false) blocked from d""")
def fairness_latch(spark, sf_dir):
    return fairness.running(_judged(spark, sf_dir), "batch", "toxic", "lang")


@query(_J + "select quality as label, round(avg(case when toxic = quality then 1.0 else 0.0 end), 6) accuracy, count(*) n from j group by 1")
def class_accuracy(spark, sf_dir):
    return fairness.accuracy_by_class(_judged(spark, sf_dir), "toxic", "quality")


# -- audit chain -------------------------------------------------------------------------------------------------------


def _log(spark, sf_dir):
    from pyspark.sql import Window

    c = F.col
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    e = table(spark, sf_dir, "events").withColumn("seq", seq)
    one = F.array(F.array(F.lit(1), (c("event_id") % 10).cast("int")))
    return e.select(
        c("user_id").alias("chain_id"), "seq", (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)") * 1000).alias("timestamp"), F.concat(F.lit("m"), c("event_id") % 13).alias("module_name"), c("event_type").alias("operator_type"), one.alias("input_shapes"),
        F.array(F.lit(1), F.lit(5)).alias("output_shape"), F.substring(F.sha2(c("event_id").cast("string"), 256), 1, 16).alias("output_hash"), F.lit("cpu").alias("device"),
    )


_CHAIN = """with recursive e as (select user_id chain_id, row_number() over (partition by user_id order by ts, event_id) seq, epoch_us(ts) * 1000 t, event_type op,
  concat('{"device": "cpu", "input_shapes": [[1, ', event_id % 10, ']], "module_name": "m', event_id % 13, '", "operator_type": "', event_type, '", "output_hash": "', substr(sha256(cast(event_id as varchar)), 1, 16), '", "output_shape": [1, 5], "prev_hash": "') head from events),
c as (select chain_id, seq, t, op, '' prev, sha256(concat(head, '", "timestamp": ', t, '}')) h from e where seq = 1
  union all select e.chain_id, e.seq, e.t, e.op, c.h, sha256(concat(e.head, c.h, '", "timestamp": ', e.t, '}')) from e join c on e.chain_id = c.chain_id and e.seq = c.seq + 1) """


@query(_CHAIN + "select chain_id, seq, prev prev_hash, h hash from c")
def audit_canonical_hash(spark, sf_dir):
    return audit.chain(_log(spark, sf_dir)).select("chain_id", "seq", "prev_hash", "hash")


@query(_CHAIN + "select chain_id, arg_max(h, seq) root_hash from c group by 1")
def audit_chain_root(spark, sf_dir):
    return audit.summary(audit.chain(_log(spark, sf_dir))).select("chain_id", "root_hash")


@query(_CHAIN + "select chain_id, count(*) n, arg_min(t, seq) first_ts, arg_max(t, seq) last_ts, count(distinct op) n_operators, arg_max(h, seq) root_hash from c group by 1")
def audit_summary(spark, sf_dir):
    return audit.summary(audit.chain(_log(spark, sf_dir)))


@query("select user_id chain_id, count(*) n, cast(0 as bigint) n_bad, cast(null as bigint) first_bad, true valid from events group by 1")
def audit_verify(spark, sf_dir):
    return audit.verify(audit.chain(_log(spark, sf_dir)), strict=True)


@query("select user_id chain_id, count(*) n, cast(least(1, count(*) filter (where rn = 3)) as bigint) n_bad, case when count(*) filter (where rn = 3) > 0 then cast(3 as bigint) end first_bad, count(*) filter (where rn = 3) = 0 valid from (select user_id, row_number() over (partition by user_id order by ts, event_id) rn from events) group by 1")
def audit_tamper(spark, sf_dir):
    t = audit.chain(_log(spark, sf_dir))
    return audit.verify(t.withColumn("timestamp", F.when(F.col("seq") == 3, F.col("timestamp") + 1).otherwise(F.col("timestamp"))))


@query("select event_type operator_type, count(*) n from events group by 1 order by n desc, 1 limit 10")
def audit_operators(spark, sf_dir):
    return audit.operator_counts(_log(spark, sf_dir))


@query("select distinct subject_id, step from (select user_id subject_id, cast(floor(event_id / 20) as bigint) step from events)")
def provenance_lookup(spark, sf_dir):
    step = F.floor(F.col("event_id") / 20)
    p = table(spark, sf_dir, "events").groupBy(step.alias("step")).agg(F.collect_list("user_id").alias("subject_ids"), F.sum("value").alias("grad_norm"))
    return audit.steps_of_subject(p).select("subject_id", "step")


# -- drift, search, snapshots --------------------------------------------------------------------------------------------

_CELLS = "with x as (select vec_id, unnest(embedding)::double v, generate_subscripts(embedding, 1) d from embeddings), "


@query(_CELLS + """b as (select d, avg(v) m0, greatest(var_samp(v), 1e-8) v0 from x where vec_id < 100 group by 1), k as (select distinct cast(floor(vec_id / 50) as bigint) batch from embeddings),
  c as (select batch, d, avg(v) m, greatest(var_samp(v), 1e-8) s from k join x on vec_id >= (batch - 1) * 50 and vec_id < (batch + 1) * 50 where batch >= 2 group by 1, 2 having count(*) >= 100)
  select batch, round(avg(0.5 * (v0 / s + (m - m0) * (m - m0) / s - 1 + ln(s) - ln(v0))), 6) kl, avg(0.5 * (v0 / s + (m - m0) * (m - m0) / s - 1 + ln(s) - ln(v0))) > 0.5 drift from c join b using (d) group by 1""")
def drift_kl(spark, sf_dir):
    return drift.kl_drift(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


_P = "with e as (select vec_id, cast(floor(vec_id / 50) as bigint) batch, list_transform(embedding, lambda x: exp(20 * cast(x as double) - 20 * list_max(embedding))) e from embeddings), p as (select *, list_transform(e, lambda x: x / list_sum(e)) p from e), "
_MEAN = "m as (select batch, d, avg(v) v from (select batch, unnest(p) v, generate_subscripts(p, 1) d from p) group by 1, 2), "
_BATCHES = _P + _MEAN + "s as (select batch, -sum(greatest(v, 1e-9) * ln(greatest(v, 1e-9))) e, list_sum(list_slice(list_reverse_sort(list(v)), 1, 3)) t from m group by 1), h as (select batch, count(*) filter (where list_max(p) < 0.5) n_human, count(*) n from p group by 1) "


def _batches(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").withColumn("logits", F.transform("embedding", lambda x: x.cast("double") * 20))
    return drift.prediction_batches(t, "vec_id", "logits", max_entropy=3.6)


@query(_BATCHES + "select batch, round(e, 6) entropy, round(t, 6) top3, n_human, n, e > 3.6 drift from s join h using (batch)")
def drift_entropy(spark, sf_dir):
    return _batches(spark, sf_dir)


@query(_BATCHES + "select cast(sum(n_human) as bigint) n_human, min(case when e > 3.6 then batch end) first_drift from s join h using (batch)")
def human_review(spark, sf_dir):
    return _batches(spark, sf_dir).agg(F.sum("n_human").alias("n_human"), F.min(F.when(F.col("drift"), F.col("batch"))).alias("first_drift"))


@query("select vec_id, round(list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))), 6) score from embeddings, (select [cast(((i * 7) % 11) - 5 as double) for i in range(64)] q) order by score desc, vec_id limit 10")
def cosine_topk(spark, sf_dir):
    return search.cosine_topk(table(spark, sf_dir, "embeddings"), [((i * 7) % 11) - 5 for i in range(64)])


@query("select vec_id, rank, cast(position as int) as position, round(s, 4) score from (select vec_id, d - 1 as position, v s, row_number() over (partition by vec_id order by -abs(v), d) rank from (select vec_id, unnest(embedding)::double v, generate_subscripts(embedding, 1) d from embeddings)) where rank <= 5")
def attr_top5(spark, sf_dir):
    return search.top_attributions(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("rank", F.col("rank").cast("long"))


def _snapshot(e):
    return e.agg(F.avg("value").alias("fairness"), (F.max("value") > 500).alias("fairness_failed"), F.sum("value").alias("epsilon"), F.avg((F.col("event_type") == "click").cast("double")).alias("accuracy"), (F.count("*") % 2 == 0).alias("drift"))


_SNAP = "select avg(value) fairness, case when max(value) > 500 then 1.0 else 0.0 end fairness_failed, sum(value) epsilon, avg(case when event_type = 'click' then 1.0 else 0.0 end) accuracy, case when count(*) % 2 = 0 then 1.0 else 0.0 end drift from events where "


@query(f"""with b as (unpivot ({_SNAP} ts < timestamp '2024-01-16') on fairness, fairness_failed, epsilon, accuracy, drift into name metric value before), a as (unpivot ({_SNAP} ts >= timestamp '2024-01-16') on fairness, fairness_failed, epsilon, accuracy, drift into name metric value after)
  select metric, round(before, 6) before, round(after, 6) after, case metric when 'fairness' then after - before > 0.02 when 'fairness_failed' then after - before > 0 when 'epsilon' then after - before > 5.0 when 'accuracy' then before - after > 0.02 else after - before > 0 end regressed from b join a using (metric)""")
def snapshot_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cut = F.to_timestamp(F.lit("2024-01-16"))
    d = snapshots.compare(_snapshot(e.where(F.col("ts") < cut)), _snapshot(e.where(F.col("ts") >= cut)))
    return d.select("metric", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "regressed")


# -- the flagship --------------------------------------------------------------------------------------------------------


@query(_records() + """, c as (select tag, count(*) n_records, round(avg(conf), 6) mean_confidence, count(*) filter (where entity_type = 'test_case') n_tests from (select *, unnest(tags) tag from rec) group by 1),
  i as (select tag, count(*) n_issues from (select unnest(tags) tag, id from rec) t join (select record_id from (""" + _ISSUES + """) where "level" = 'warning') w on w.record_id = t.id group by 1)
  select tag, n_records, mean_confidence, n_tests, coalesce(n_issues, 0) n_issues from c left join i using (tag)""")
def pipeline_end_to_end(spark, sf_dir):
    """Annotate, validate and cover: records, confidence, tests and warnings for each article."""
    r = records(spark, sf_dir)
    t = r.select("id", "mapping_confidence", "entity_type", F.explode(F.array_distinct("compliance_tags")).alias("tag"))
    warned = organize.issues(r).where("level = 'warning'").groupBy("record_id").agg(F.count("*").alias("w"))
    j = t.join(warned, t.id == warned.record_id, "left")
    return j.groupBy("tag").agg(F.count("*").alias("n_records"), F.round(F.avg("mapping_confidence"), 6).alias("mean_confidence"), F.count_if(F.col("entity_type") == "test_case").alias("n_tests"), F.coalesce(F.sum("w"), F.lit(0)).alias("n_issues"))
