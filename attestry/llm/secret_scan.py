"""Secret scans with an incremental blob ledger.

Every version of a text is content-addressed by its SHA-256. The ledger is a table of (blob, rule version,
findings), blobs without findings included. A run scans the blobs whose pair with the current rule version is
not in the ledger yet, appends what it found, and joins findings back to every path. Texts are scanned where they are
read and never shuffled: a task scans a blob once however many of its rows hold it, and what several tasks have found
in copies is one entry of the ledger. A lost run leaves the ledger as it was or appends nothing: files show up only when
the whole append is committed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, exists

#: kind, expression, and how long the match (of ``assign``: its value) must be to count. The first three are the base rules.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
RULES = (
    ("assign", _ASSIGN, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20),
    ("hex", re.compile(r"[0-9a-f]+"), 24),
    ("private_key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0),
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"), 0),
    ("bearer", re.compile(r"\b[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*"), 0),
    ("url_login", re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"), 0),
)
BASE = ("assign", "access", "hex")
#: Changes with the rules, so that a new set scans every blob again.
RULE_VERSION = hashlib.sha256("\n".join(f"{k}:{r.pattern}:{r.flags}:{least}" for k, r, least in RULES).encode()).hexdigest()[:16]

#: Texts of which spans are held at once.
SLICE = 256
_LEDGER = "blob binary, rule_version string, spans array<struct<kind:string,start:int,stop:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
# A long run of lower-case hexadecimal digits, and nothing shorter, holds a base match of its kind: maximal
# runs are what the leftmost longest matches of [0-9a-f]+ are.
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = re.compile(r"passw|secret|token|api_?key", re.A | re.I)


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind in the rules' order."""
    out = []
    for order, (kind, rule, least) in enumerate(RULES):
        if kind == "hex":
            rule = _HEX
        elif kind == "assign" and not _WORDS.search(text):
            continue
        elif kind == "access" and "AKIA" not in text or kind == "url_login" and "://" not in text or kind == "jwt" and "eyJ" not in text or kind == "private_key" and "-----BEGIN " not in text or kind == "bearer" and "earer" not in text:
            continue
        out += [(m.start(), order, kind, m.end()) for m in rule.finditer(text) if len(m[2] if kind == "assign" else m[0]) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blob, text) -> ledger rows of the task's different blobs. One text at a time is a Python string."""
    seen: set[bytes] = set()  # 32 bytes for each text of the task
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            b = whole.slice(at, SLICE)
            blobs, spans = [], []
            for blob, text in zip(b.column(0).to_pylist(), b.column(1)):
                if blob not in seen:
                    seen.add(blob)
                    blobs.append(blob)
                    spans.append([{"kind": k, "start": s, "stop": e} for k, s, e in find(text.as_py())])
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array([RULE_VERSION] * len(blobs), pa.string()), pa.array(spans, _SPANS)], names=["blob", "rule_version", "spans"])


def blob_id(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"), 256))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """Findings under the current rules, each blob once, also where two runs at once have appended it."""
    if not exists(spark, ledger):
        return spark.createDataFrame([], _LEDGER)
    rows = spark.read.schema(_LEDGER).parquet(ledger).where(F.col("rule_version") == RULE_VERSION)
    return rows.dropDuplicates(["blob"])


def update_ledger(df: DataFrame, ledger: str, text: str = "text") -> DataFrame:
    """Scan what the ledger at ``ledger`` lacks, append it, and return the ledger's findings."""
    spark = df.sparkSession
    blobs = df.select(blob_id(text).alias("blob"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    if exists(spark, ledger):
        blobs = blobs.join(read_ledger(spark, ledger).select("blob"), "blob", "left_anti")
    blobs.mapInArrow(_scan, _LEDGER).dropDuplicates(["blob"]).write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger)


def findings(df: DataFrame, id_col: str = "doc_id", text: str = "text", ledger: str | None = None) -> DataFrame:
    """``id_col``, ``blob`` and ``spans`` for every row of ``df``, rows without a secret included.

    Null text is empty. Texts of any length are scanned whole. Repeated rows and copies get the same spans. Null ids
    are kept. An empty table gives an empty result. Only the id and the text are read, so other columns' names cannot
    clash. Without ``ledger`` a new one is begun in the shared folder.
    """
    ledger = ledger or f"{Scratch(df.sparkSession, 'secrets').root}/ledger"
    dirty = update_ledger(df, ledger, text).where("size(spans) > 0").select("blob", "spans")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), blob_id(text).alias("blob"))
    spans = F.coalesce("spans", F.array().cast(dirty.schema["spans"].dataType))
    return rows.join(dirty, "blob", "left").select(F.col("id").alias(id_col), "blob", spans.alias("spans"))


def mask(df: DataFrame, text: str = "text", ledger: str | None = None, count: str | None = "n_chars") -> DataFrame:
    """``df`` with every finding replaced by ``[MASKED:kind]``; overlapping findings become one of the first kind.

    What stands in is no finding itself, so a second scan is clean. Columns keep their names, whatever they are, their
    order and types; ``count``, if ``df`` has it, holds the new length. Rows are masked one by one, null texts stay null,
    repeated rows are alike, ids are not read, an empty table gives an empty result.
    """
    ledger = ledger or f"{Scratch(df.sparkSession, 'secrets').root}/ledger"
    dirty = update_ledger(df, ledger, text).where("size(spans) > 0").select("blob", "spans")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), blob_id(text).alias("blob"))
    joined = rows.join(dirty, "blob", "left")
    old = F.col(f"row.`{text}`")
    new = F.when(F.col("spans").isNull(), old).otherwise(_masked(old, F.col("spans")))
    out = {c: F.col(f"row.`{c}`") for c in df.columns} | {text: new}
    if count and count in df.columns:
        out[count] = F.when(F.col("spans").isNull(), out[count]).otherwise(F.length(new)).cast(df.schema[count].dataType)
    return joined.select(*(v.alias(c) for c, v in out.items()))


def _masked(text, spans):
    """Fold over the spans by start: (done, at) holds the text so far and where the next piece begins."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(acc, s):
        piece = F.concat(acc["done"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("[MASKED:"), s["kind"], F.lit("]"))
        inside = s["start"] < acc["at"]
        return F.struct(F.when(inside, acc["done"]).otherwise(piece).alias("done"), F.greatest(acc["at"], s["stop"]).alias("at"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))


def joined_spans(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
