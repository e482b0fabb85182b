"""Record tables derived from the test tables: one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import with_defaults


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(column: str, values: list[str]) -> str:
    cases = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"case {column} % {len(values)} {cases} end"


_KEY = "p_partkey"
#: Every part stands for one record; its key decides name, place, kind and text.
PART = f"""select {_KEY} as input_seq, concat('p', cast({_KEY} as string)) as id,
  {_pick(_KEY, ['torch/utils/data/loader.py', 'torch/onnx/utils.py', 'torch/nn/modules/module.py', 'torch/_dynamo/guards.py', 'aten/src/ops.cpp', 'test/test_nn.py'])} as source_file,
  {_pick(_KEY, ['python', 'cpp', 'yaml', 'rst', 'perl'])} as language,
  {_pick(_KEY, ['register_forward_hook', 'DataLoader', 'predict_label', 'save', 'helper', 'manual_seed', 'make_private', 'verify_key', 'FuncTorchBatched', 'grad_fn', 'state_dict_hook'])} as entity_name,
  {_pick(_KEY, ['class', 'method', 'function', 'test_case', 'gadget', 'operator', 'enum'])} as entity_type,
  {_pick(_KEY, ['hook_definition', 'hook_consumer', 'data_loading', 'dispatch_key', 'torchscript', 'serialization', 'override_protocol', 'profiler_hook', 'graph_break_reason', 'autograd_extension', 'plain', 'fx_graph', ''])} as subcategory,
  case when {_KEY} % 17 = 0 then '' else concat('torch.', {_pick(_KEY, ['nn', 'utils', 'onnx'])}, '.m', cast(p_size as string)) end as module_path,
  case when {_KEY} % 19 = 0 then '' else concat('torch.', p_brand, '.autograd', cast({_KEY} % 40 as string)) end as qualified_name,
  cast({_KEY} % 50 as int) as start_line,
  {_pick(_KEY, ['', 'x.register_hook(f)', 'def register_hook(f)', 'torch.distributed.barrier', 'module.parameters()', 'torch.library.impl', 'all_gather (t)', 'import os'])} as raw_text,
  concat(p_name, {_pick(_KEY, ['', ' keeps an audit trail', ' and data privacy', ' with numerical stability', ' under human oversight; monitoring'])}) as docstring,
  case when {_KEY} % 23 = 0 then 1.5e0 else 0.9e0 end as extraction_confidence,
  case {_KEY} % 4 when 0 then 0.3e0 else 0e0 end as mapping_confidence
from part"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part")
    return with_defaults(spark.sql(PART.replace("from part", "from {part}"), part=t)).withColumn("input_seq", F.col("input_seq"))
