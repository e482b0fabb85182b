"""Queries of the scalar expressions and of the operators that the record queries do not reach, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims, exprs
from ..operators import annotate, consent, organize
from .entities import table
from .queries import q, query, tags_text

# -- scalar expressions --------------------------------------------------------------------------------------------


@query("""select p_partkey, concat_ws('.', p_type, case when p_partkey % 3 = 0 then null else p_brand end, case when p_partkey % 2 = 0 then null else p_name end) qualified from part""")
def expr_qualified_name(spark, sf_dir):
    some = lambda n, c: F.when(F.col("p_partkey") % n == 0, "").otherwise(F.col(c))
    return table(spark, sf_dir, "part").select("p_partkey", exprs.qualified_name(F.col("p_type"), some(3, "p_brand"), some(2, "p_name")).alias("qualified"))


@query("""with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents), s as (select doc_id, array_to_string(l[2:4], chr(10)) x from t)
select doc_id, md5(case when length(x) > 300 then left(x, 300) || chr(10) || '... [truncated]' else x end) part from s""")
def expr_raw_slice(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(exprs.raw_slice(t, F.lit(2), F.lit(4), 300)).alias("part"))


_TAG = "case p_partkey % 4 when 0 then 'eu_ai_act_art_' || (p_partkey % 90) when 1 then 'gdpr_art_' || (p_partkey % 90) when 2 then 'iso_art_' || p_size else 'none' end"


@query(f"""with t as (select p_partkey, {_TAG} tag from part) select p_partkey,
  case when starts_with(tag, 'eu_ai_act_art_') then 'https://example.org/legal/eu-ai-act/Art' || string_split(tag, '_art_')[-1] when starts_with(tag, 'gdpr_art_') then 'https://example.org/legal/gdpr/Art' || string_split(tag, '_art_')[-1] end uri,
  upper(replace(string_split(tag, '_art_')[1], '_', ' ')) || ' Art.' || string_split(tag, '_art_')[-1] as label from t""")
def expr_tag_uri_label(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.expr(_TAG).alias("tag"))
    return t.select("p_partkey", exprs.tag_uri(F.col("tag")).alias("uri"), exprs.tag_label(F.col("tag")).alias("label"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 'Unknown' else 'Art' || (o_orderkey % 99) end article from orders""")
def expr_article_of(spark, sf_dir):
    text = F.expr("case when o_orderkey % 3 = 0 then concat('Rec', o_orderkey, ' Art5') else concat('Art', o_orderkey % 99, '.2 keep records') end")
    return table(spark, sf_dir, "orders").select("o_orderkey", exprs.article_of(text).alias("article"))


@query("""select page_id, md5(regexp_replace(html, '[\\x00-\\x1f\\x7f]', '', 'g')) safe from pages""")
def expr_safe_log(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(exprs.safe_log(F.col("html"))).alias("safe"))


@query("select doc_id, left(sha256(coalesce(text, '')), 16) hash from documents")
def expr_tensor_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", exprs.tensor_hash(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))


@query("""with t as (select p_partkey, case p_partkey % 3 when 0 then 'x' when 1 then cast(p_size as varchar) else cast(p_retailprice / 4000 as varchar) end v from part)
select p_partkey, round(coalesce(greatest(0.0, least(1.0, try_cast(v as double))), 0.5), 6) c from t""")
def expr_clamp(spark, sf_dir):
    v = F.expr("case p_partkey % 3 when 0 then 'x' when 1 then cast(p_size as string) else cast(p_retailprice / 4000 as string) end")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(exprs.clamp(v, 0.5), 6).alias("c"))


@query("""select doc_id, md5(case when coalesce(text, '') <> '' then source || ': ' || left(text, 200) else source end) embedded from documents""")
def expr_embed_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(exprs.embed_text(F.col("source"), F.coalesce("text", F.lit("")))).alias("embedded"))


@query("""select c_custkey, i, 'customer ' || c_custkey || case when i = 2 then ' again' else '' end as subject, c_mktsegment as object, case when i = 2 then 'leaves' else 'belongs to' end relation
from customer, range(1, 3) r(i) where i = 1 or c_custkey % 2 = 0""")
def expr_triplets(spark, sf_dir):
    text = F.expr(
        "concat('<s><triplet> customer ', c_custkey, ' <subj> ', c_mktsegment, ' <obj> belongs to', case when c_custkey % 2 = 0 then concat(' <triplet> customer ', c_custkey, ' again <subj> ', c_mktsegment, ' <obj> leaves') else '' end, '</s>')"
    )
    t = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(exprs.triplets(text)).alias("i", "t"))
    return t.select("c_custkey", (F.col("i") + 1).cast("long").alias("i"), "t.subject", "t.object", "t.relation")


_HOOK_NAMES = "('register_forward_hook', 'backward_step', 'gradient', 'state_dict', 'load_all', 'train', 'eval_mode', 'profile_step', 'record_it', 'trace', 'dispatch', 'other')"


@query(f"""with t as (select p_partkey, (list_value{_HOOK_NAMES})[cast(p_partkey % 12 as integer) + 1] n from part)
select p_partkey, case when contains(n, 'forward') then 'forward' when contains(n, 'backward') or contains(n, 'grad') then 'backward' when contains(n, 'state_dict') or contains(n, 'load') then 'serialization'
  when contains(n, 'train') or contains(n, 'eval') then 'mode' when contains(n, 'profile') or contains(n, 'record') or contains(n, 'trace') then 'profiling' when contains(n, 'dispatch') then 'dispatch' else 'runtime' end phase from t""")
def expr_hook_phase(spark, sf_dir):
    n = F.expr(f"element_at(array{_HOOK_NAMES}, cast(p_partkey % 12 as int) + 1)")
    return table(spark, sf_dir, "part").select("p_partkey", exprs.hook_phase(n).alias("phase"))


@query("""select page_id, left(case when contains(url, '#') then string_split(url, '#')[-1] when starts_with(url, 'http') then string_split(url, '/')[-1] else url end, 40) cell from pages""")
def expr_cell(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", exprs.cell(F.col("url")).alias("cell"))


@query("""select o_orderkey, case o_orderkey % 3 when 0 then '[' || o_custkey || ', {"a": 1}]' when 1 then '{"b": ' || o_custkey || '}' else '' end found from orders""")
def expr_json_salvage(spark, sf_dir):
    text = F.expr("""case o_orderkey % 3 when 0 then concat('<think>[9]</think> so: [', o_custkey, ', {"a": 1}] done') when 1 then concat('it is {"b": ', o_custkey, '} I think') else 'nothing' end""")
    return table(spark, sf_dir, "orders").select("o_orderkey", exprs.json_salvage(text).alias("found"))


@query("""select doc_id, length(left(text, n)) - length(replace(left(text, n), chr(10), '')) + 1 as line_no from (select doc_id, text, length(text) // 2 n from documents where text is not null)""")
def expr_line_of(spark, sf_dir):
    t = table(spark, sf_dir, "documents").where("text is not null").withColumn("before", F.expr("substring(text, 1, length(text) div 2)"))
    return t.select("doc_id", exprs.line_of(F.col("before")).cast("long").alias("line_no"))


# -- tagging over all names and phrases ----------------------------------------------------------------------------

_N, _P = len(dims.NAMES), len(dims.PHRASES)
_strings = lambda values: ", ".join(map(q, values))
_listed = lambda rows: ", ".join("[" + _strings(t) + "]" for t in rows)


@query(f"""select p_partkey, array_to_string(([{_listed(dims.NAMES.values())}])[cast(p_partkey % {_N} as integer) + 1], ',') tags from part""")
def tag_all_names(spark, sf_dir):
    """Every name of the table in turn."""
    name = F.expr(f"element_at(array({_strings(dims.NAMES)}), cast(p_partkey % {_N} as int) + 1)")
    return table(spark, sf_dir, "part").select("p_partkey", tags_text(annotate.lookup(dims.NAMES, name)).alias("tags"))


_PHRASE_DOC = f"'On ' || upper(([{_strings(p for p, _ in dims.PHRASES)}])[cast(p_partkey % {_P} as integer) + 1]) || ' as such'"


@query(
    f"with t as (select p_partkey, lower({_PHRASE_DOC}) d from part) select p_partkey, array_to_string(list_sort(list_distinct(flatten(["
    + ", ".join(f"case when contains(d, {q(p)}) then [{_strings(t)}] else []::varchar[] end" for p, t in dims.PHRASES)
    + "]))), ',') tags from t"
)
def tag_all_phrases(spark, sf_dir):
    """Every phrase of the table in turn; a phrase may hold others."""
    doc = F.expr(f"concat('On ', upper(element_at(array({_strings(p for p, _ in dims.PHRASES)}), cast(p_partkey % {_P} as int) + 1)), ' as such')")
    t = table(spark, sf_dir, "part").select("p_partkey", F.lower(doc).alias("d"))
    tags = F.flatten(F.array(*(F.when(F.contains("d", F.lit(p)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for p, v in dims.PHRASES)))
    return t.select("p_partkey", tags_text(F.array_sort(F.array_distinct(tags))).alias("tags"))


# -- ratings, labels, candidates --------------------------------------------------------------------------------------

_RATED = "select cast(p_partkey as string) as id, array('a', 'b') as compliance_tags, (p_partkey % 10) / 10.0e0 as mapping_confidence, '' as mapping_rationale, case when p_partkey % 7 = 0 then map('llm_mapping_validated', 'true') else cast(map() as map<string, string>) end as metadata, 'commit' as subcategory from {part}"


def _rated(spark, sf_dir):
    return spark.sql(_RATED, part=table(spark, sf_dir, "part"))


@query("select cast(p_partkey as varchar) id from part where (p_partkey % 10) / 10.0 < 0.7 and p_partkey % 7 <> 0")
def rating_candidates(spark, sf_dir):
    return annotate.unsure(_rated(spark, sf_dir)).select("id")


@query("""with r as (select cast(p_partkey as varchar) id, (p_partkey % 10) / 10.0 conf, p_partkey % 5 k, p_partkey % 7 = 0 seen from part)
select id, case k when 2 then 'b' when 4 then 'b' else 'a,b' end tags, round(cast(case k when 0 then greatest(conf, 0.8) when 1 then greatest(conf, 0.7 * 0.5) else conf end as double), 6) conf, case k when 0 then 'because' else '' end as why, k < 4 or k = 4 or seen as validated from r""")
def rating_merge(spark, sf_dir):
    """Direct, indirect, none, no confidence, and no relevance at all, in turn."""
    r = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("record_id"), F.lit("a").alias("tag"), F.expr("case p_partkey % 5 when 0 then 'direct' when 1 then 'indirect' when 2 then 'none' when 3 then 'direct' end").alias("relevance"),
        F.expr("case p_partkey % 5 when 0 then '0.8' when 1 then '0.5' when 2 then '0.9' end").alias("confidence"), F.expr("case p_partkey % 5 when 0 then 'because' else '' end").alias("reason"),
    )
    t = annotate.apply_ratings(_rated(spark, sf_dir), r)
    return t.select("id", tags_text().alias("tags"), F.round("mapping_confidence", 6).alias("conf"), F.col("mapping_rationale").alias("why"), F.coalesce(F.try_element_at("metadata", F.lit(annotate.VALIDATED)) == "true", F.lit(False)).alias("validated"))


_LABELS = ("security_fix", "determinism_change", "deprecation", "breaking_change", "hook_change", "data_handling", "not_relevant", "a word of its own")


@query(
    f"""with t as (select p_partkey, ([{_strings(_LABELS)}])[cast(p_partkey % 9 as integer) + 1] l from part)
select cast(p_partkey as varchar) id, case when l is null or l = 'a word of its own' then 'commit' else l end subcategory, case """
    + " ".join(f"when l = {q(k)} then {q(v)}" for k, v in (("security_fix", "eu_ai_act_art_15"), ("determinism_change", "eu_ai_act_art_9"), ("deprecation", "eu_ai_act_art_11"), ("breaking_change", "eu_ai_act_art_11"), ("hook_change", "eu_ai_act_art_14"), ("data_handling", "eu_ai_act_art_10"), ("not_relevant", "")))
    + " else 'a,b' end tags from t"
)
def commit_relabel(spark, sf_dir):
    label = F.try_element_at(F.array(*map(F.lit, _LABELS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    labels = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("record_id"), label.alias("label"))
    return annotate.relabel_commits(_rated(spark, sf_dir), labels).select("id", "subcategory", tags_text().alias("tags"))


# -- edges, merges, logs ---------------------------------------------------------------------------------------------


@query("""with n as (select replace(p_name, ' ', '.') || '.' || p_partkey as name, 'p' || p_partkey id from part), m as (select name, max(id) target from n where length(name) >= 8 and regexp_matches(name, '(^|[._])[a-zA-Z][^._]{3,}') group by 1),
t as (select 'o' || o_orderkey id, 'see ' || replace(p_name, ' ', '.') || '.' || p_partkey || ', ordered' as text from orders join part on p_partkey = o_orderkey % 200 + 1)
select t.id source, m.target, m.name from t join m on contains(t.text, m.name) where t.id <> m.target""")
def name_edges(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("name", F.concat_ws(".", F.replace("p_name", F.lit(" "), F.lit(".")), "p_partkey"))
    o = table(spark, sf_dir, "orders").join(p, F.col("p_partkey") == F.col("o_orderkey") % 200 + 1)
    texts = o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("see "), "name", F.lit(", ordered")).alias("text"))
    return organize.name_edges(texts, p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), "name"))


@query("""select cast(l_orderkey as varchar) || '-' || l_linenumber as source, case when l_linenumber % 3 = 0 then '' else cast(l_partkey as varchar) end target, case when l_linenumber % 2 = 0 then 'unknown' else 'uses' end as "type" from lineitem""")
def relation_edges(spark, sf_dir):
    rel = F.array(F.struct(F.when(F.col("l_linenumber") % 2 != 0, "uses").alias("type"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey").cast("string")).alias("target")))
    return organize.relation_edges(table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), rel.alias("relations")))


@query("select cast(count(*) as bigint) n_samples, count(distinct event_type) n_classes from events")
def class_sizes(spark, sf_dir):
    return consent.class_profile(table(spark, sf_dir, "events"), "event_type").select("n_samples", "n_classes")

