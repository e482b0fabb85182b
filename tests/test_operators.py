"""Operators on small fixtures with results known by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from attestry.functions import exprs
from attestry.operators import annotate, audit, consent, drift, fairness, organize, search, snapshots
from attestry.schema import FIELDS, with_defaults
from attestry.sources import catalog, extract, files
from attestry.streaming import stateful

RECORD = {"id": "a1", "source_file": "torch/nn/module.py", "language": "python", "entity_name": "forward", "entity_type": "method", "start_line": 10}


def records(spark, *rows):
    rows = [{"input_seq": i, **RECORD, **r} for i, r in enumerate(rows)]
    keys = sorted({k for r in rows for k in r})
    types = {"start_line": "int", "input_seq": "bigint", "compliance_tags": "array<string>", "mapping_confidence": "double", "extraction_confidence": "double", "export_survival": "map<string,string>", "metadata": "map<string,string>"}
    return with_defaults(spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], ", ".join(f"{k} {types.get(k, 'string')}" for k in keys)))


def test_parity(spark):
    t = spark.createDataFrame(list(zip([1, 1, 0, 0, 0, 0], [0, 0, 0, 1, 1, 1])), "p int, g int")
    assert fairness.parity(t, "p", "g").first().disparity == pytest.approx(2 / 3)
    assert fairness.parity(t.where("g = 0"), "p", "g").first().disparity is None


def test_consent(spark):
    reads = spark.createDataFrame([("s0",), ("s1",), ("s2",), ("s9",)], "subject_id string")
    registry = spark.createDataFrame([("s0", True, ["a"]), ("s1", False, ["a"]), ("s2", True, ["b"])], "subject_id string, consent boolean, purposes array<string>")
    log = {r.subject_id: r.reason for r in consent.access_log(reads, registry, "a").collect()}
    assert log == {"s0": "consent_granted", "s1": "consent_withdrawn", "s2": "purpose_not_listed", "s9": "consent_withdrawn"}
    assert [r.subject_id for r in consent.granted(reads, registry, "a").collect()] == ["s0"]
    assert consent.denied(reads, registry, "a").count() == 3


def test_imbalance(spark):
    t = spark.createDataFrame([("a",)] * 100 + [("b",)] * 10, "c string")
    one = consent.class_profile(t, "c").first()
    assert (one.n_samples, one.n_classes, one.imbalance, one.warning) == (110, 2, 10.0, True)
    assert consent.imbalance(t.where("c = 'a'"), "c").first().ratio == 1.0


def _log(spark, n=8):
    rows = [("c", i, 1000 + i, f"m{i}", "Linear", [[1, 10]], [1, 5], "00", "cpu") for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "chain_id string, seq bigint, timestamp bigint, module_name string, operator_type string, input_shapes array<array<int>>, output_shape array<int>, output_hash string, device string")


def test_chain_is_the_sequential_fold(spark):
    last, want = "", []
    for i in range(1, 9):
        row = {"device": "cpu", "input_shapes": [[1, 10]], "module_name": f"m{i}", "operator_type": "Linear", "output_hash": "00", "output_shape": [1, 5], "prev_hash": last, "timestamp": 1000 + i}
        last = hashlib.sha256(json.dumps(row, sort_keys=True).encode()).hexdigest()
        want.append(last)
    assert [r.hash for r in audit.chain(_log(spark)).orderBy("seq").collect()] == want


def test_tampering_is_found(spark):
    t = audit.chain(_log(spark)).persist()
    assert audit.verify(t, strict=True).first().valid
    bad = audit.verify(t.withColumn("timestamp", F.when(F.col("seq") == 3, 0).otherwise(F.col("timestamp")))).first()
    assert (bad.first_bad, bad.n_bad, bad.valid) == (3, 1, False)
    gone = t.where("seq <> 4")
    assert audit.verify(gone).first().valid and audit.verify(gone, strict=True).first().first_bad == 5


def test_dedup_merges_in_order(spark):
    t = records(spark, {"compliance_tags": ["a"]}, {"docstring": "d", "signature": "s", "compliance_tags": ["b", "a"], "mapping_confidence": 0.4}, {"entity_name": "other"})
    got = {r.entity_name: r for r in organize.dedup(t).collect()}
    assert set(got) == {"forward", "other"}
    assert (got["forward"].docstring, got["forward"].compliance_tags, got["forward"].mapping_confidence) == ("d", ["b", "a"], 0.4)


def test_annotate_is_idempotent_on_tags(spark):
    t = records(spark, {"entity_name": "register_forward_hook", "subcategory": "hook_definition"}, {"entity_name": "nothing", "source_file": "x.py"})
    once = annotate.annotate(t)
    twice = annotate.annotate(once)
    assert [r.compliance_tags for r in once.orderBy("input_seq").collect()] == [r.compliance_tags for r in twice.orderBy("input_seq").collect()]
    assert once.columns[: len(FIELDS)] == list(FIELDS)
    assert once.where("entity_name = 'nothing'").first().compliance_tags == []


def test_validation(spark):
    t = records(spark, {"id": "", "extraction_confidence": 1.5}, {"id": "x"}, {"id": "x", "input_seq": 7})
    levels = {r.level: r.n for r in organize.issue_counts(organize.issues(t)).collect()}
    assert levels["error"] == 1 and levels["warning"] == 1
    assert [(r.record_id, r.input_seq) for r in organize.duplicate_ids(t).collect()] == [("x", 7)]
    tied = spark.createDataFrame([("y", 1)] * 3, "id string, input_seq bigint")
    assert organize.duplicate_ids(tied).count() == 2


def test_histogram_keeps_every_row(spark):
    t = spark.createDataFrame([(x,) for x in (-0.5, 0.0, 0.19, 0.2, 0.79, 0.8, 1.0, 3.0)], "x double")
    assert [r.n for r in organize.histogram(t, "x").orderBy("bin").collect()] == [3, 1, 0, 1, 3]


def test_paragraphs(spark):
    t = spark.createDataFrame([("short ",), ("a" * 1500 + "\n\n" + "b" * 600 + "\n\n" + "c" * 100,)], "t string")
    got = [r.c for r in t.select(exprs.pack_paragraphs(F.col("t")).alias("c")).collect()]
    assert got[0] == ["short "] and [len(x) for x in got[1]] == [1500, 702]


def test_softmax_and_unit(spark):
    t = spark.createDataFrame([([1.0, 2.0, 3.0],), ([0.0, 0.0, 0.0],)], "v array<double>")
    a, b = t.select(exprs.softmax(F.col("v")).alias("p"), exprs.unit(F.col("v")).alias("u")).collect()
    assert sum(a.p) == pytest.approx(1) and a.p[2] == pytest.approx(0.66524096) and sum(x * x for x in a.u) == pytest.approx(1)
    assert b.u == [0.0] * 3 and b.p == pytest.approx([1 / 3] * 3)


def test_budget_and_topk(spark):
    log = spark.createDataFrame([("r", 1, 2.0), ("r", 2, 9.0), ("r", 3, 1.0)], "run string, step int, e double")
    assert [r.over for r in drift.budget(log, "run", "step", "e", 8.0).orderBy("step").collect()] == [False, True, True]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1])], "vec_id bigint, embedding array<double>")
    assert [r.vec_id for r in search.cosine_topk(v, [1, 0], 2).collect()] == [1, 3]


def test_snapshots(spark):
    kind = "fairness double, epsilon double, accuracy double, drift boolean"
    a, b = spark.createDataFrame([(0.05, 4.0, 0.9, False)], kind), spark.createDataFrame([(0.08, 9.0, None, True)], kind)
    got = {r.metric: r.regressed for r in snapshots.compare(a, b).collect()}
    assert got == {"fairness": True, "epsilon": False, "drift": True}
    with pytest.raises(RuntimeError):
        snapshots.assert_no_regression(snapshots.compare(a, b))


def test_record_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"id": "1", "unknown": 3}) + "\n\nnot json\n" + json.dumps({"id": "2", "start_line": 5}) + "\n")
    got = files.read_records(spark, f"file://{tmp_path}/a.jsonl").orderBy("input_seq").collect()
    assert [(r.id, r.start_line, r.extraction_confidence) for r in got] == [("1", 0, 1.0), ("2", 5, 1.0)]
    files.write_csv(files.read_records(spark, f"file://{tmp_path}/a.jsonl"), f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 2


def test_python_catalog(spark, tmp_path):
    (tmp_path / "torch").mkdir()
    (tmp_path / "torch" / "mock.py").write_text('import os\n\nclass A(B):\n    """Doc."""\n    def f(self, x):\n        return x\n\ndef g():\n    pass\n')
    rows = catalog.extract(files.read_texts(spark, f"file://{tmp_path}", "*.py"), "python").collect()
    assert {("A", "class"), ("f", "method"), ("g", "function")} <= {(r.entity_name, r.entity_type) for r in rows}


def test_chain_stream_survives_a_restart(spark, tmp_path):
    shape = "chain_id bigint, event_id bigint, timestamp bigint, module_name string, operator_type string, input_shapes array<array<int>>, output_shape array<int>, output_hash string, device string"
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("src", "out", "check"))
    rows = [(i % 2, i, 100 + i, "m", "op", [[1]], [1], "00", "cpu") for i in range(12)]
    for part in (rows[:7], rows[7:]):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(src)
        q = stateful.write_log(stateful.chain_stream(spark.readStream.schema(shape).parquet(src)), out, check).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    seq = spark.createDataFrame(rows, shape).withColumn("seq", F.floor(F.col("event_id") / 2) + 1)
    want = {(r.chain_id, r.event_id): r.hash for r in audit.chain(seq).collect()}
    assert {(r.chain_id, r.event_id): r.hash for r in spark.read.json(out).collect()} == want


def test_passages_are_found_at_punctuation_and_without_long_words(spark, tmp_path):
    """A passage's first and last word may touch other characters; short words and single words count too."""
    import duckdb

    from attestry.plans.queries import SQL, xref_name_match

    texts = ["so (wonderful as it is) ends", "as it was wonderful.", "is it so or not, I ask", "xunbelievabley", "a\tb c dd e ff", "nothing", None, ""]
    names = ["wonderful as it is", "it was wonderful", "it so or no", "unbelievable", "b c dd e f", "nothing", "absent words here", "two words"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(names)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = {(r.doc_id, r.item_id) for r in xref_name_match(spark, str(tmp_path)).collect()}
    assert got == set(con.execute(SQL["xref_name_match"]).fetchall()) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)}


def test_records_of_json_arrays_and_many_files(spark, tmp_path):
    """Lines first, then arrays and single objects, by name; malformed ones are skipped."""
    (tmp_path / "b.jsonl").write_text('{"id": "b1"}\nnot json\n\n{"id": "b2", "other": 1}\n')
    (tmp_path / "a.json").write_text('[{"id": "a1"},\n {"id": "a2"}]')
    (tmp_path / "c.json").write_text('{"id": "c1",\n "entity_name": "x"}')
    (tmp_path / "d.json").write_text("[{broken")
    for i in range(1100):
        (tmp_path / f"e{i:04d}.jsonl").write_text(f'{{"id": "e{i}"}}\n')
    got = files.read_records(spark, f"file://{tmp_path}").orderBy("input_seq").collect()
    assert [r.id for r in got] == ["b1", "b2", *(f"e{i}" for i in range(1100)), "a1", "a2", "c1"]
    assert len({r.input_seq for r in got}) == len(got) and got[-1].entity_name == "x"


def test_all_names_are_looked_for(spark):
    """More names than a switch once allowed, and a common word that pairs nothing."""
    names = spark.range(25_000).select(F.concat(F.lit("n"), "id").alias("id"), F.concat(F.lit("torch.common.name_"), "id", F.lit("_end")).alias("name"))
    texts = spark.createDataFrame([("t1", "torch.common.name_17_end and torch common"), ("t2", "see torch.common.name_24999_end."), ("n3", "torch.common.name_3_end")], "id string, text string")
    got = {(r.source, r.target) for r in organize.name_edges(texts, names).collect()}
    assert got == {("t1", "n17"), ("t2", "n24999")}


def test_names_are_found_wherever_they_lie(spark):
    """Inside longer words, after a wide character, in equal texts, and whatever words other texts hold."""
    names = spark.createDataFrame([("a", "cream.soda"), ("b", "DataLoader"), ("c", "long_name.x"), ("d", "ab.cd.12345")], "id string, name string")
    texts = spark.createDataFrame([(1, "icecream.sodas"), (2, "one cream"), (3, "soda"), (4, "soda \U0001F600 MyDataLoaderX"), (5, "a long_name.xy"), (6, "a long_name.xy"), (7, "ab.cd.12345"), (8, None)], "id int, text string")
    got = sorted((r.source, r.target) for r in organize.name_edges(texts.withColumn("id", F.col("id").cast("string")), names).collect())
    assert got == [("1", "a"), ("4", "b"), ("5", "c"), ("6", "c")]


def test_all_commits_are_listed(spark):
    log = spark.range(6000).select(F.concat(F.lit("c"), "id", F.lit("|||me|||2020-01-01|||security fix")).alias("value"))
    assert extract.commits(log).count() == 6000 and extract.commits(log, 10).count() == 10


def test_texts_are_lowered_once(spark):
    """Not once for each phrase, inside the lambda."""
    tags, said = annotate.phrase_tags([("a b", ["t"]), ("c", ["u"])], F.col("d"))
    df = spark.createDataFrame([("C, A B",), ("x",), (None,)], "d string").select(tags.alias("t"), said.alias("p"))
    assert [(r.t, r.p) for r in df.collect()] == [(["t", "u"], ["a b", "c"]), ([], []), ([], [])]
    assert "contains(lower(" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
