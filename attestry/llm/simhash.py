"""SimHash near-dedup: Golay-code fuzzy hashing of fingerprint segments, exact verification, union-find.

Method. A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to the 23 bits of the
perfect binary Golay code, whose spheres of radius 3 fill the space: every segment has exactly one nearest
codeword, named by its 12-bit index. Two fingerprints that differ in at most two bits have a midpoint at one
bit or less from either, so by pigeonhole at most one segment of either carries one error. Decoding the
fingerprint and its one-bit neighbours segment by segment gives up to 16 triples of codeword indices
(36 bits), and linked fingerprints share at least one of them. Keys held by one fingerprint alone are
dropped. The survivors are verified without pairing a bucket's members: within a key the neighbours that
decode to it are told apart by their coset leaders, and fingerprints that share a neighbour differ in at
most two bits - exactly the link, with no false and no lost one. A neighbour is shared by at most 65
fingerprints, whatever the data, so links are stars of bounded size even inside groups of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components
from .line_dedup import settle

SEED, SHINGLE = 42, 3
#: Near copies by similarity: minima a key, keys a text, and the Jaccard similarity that links.
ROWS, BANDS, THRESHOLD = 4, 14, 0.8
#: (shift, bits) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
_POLY = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the (23, 12) code


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    r = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        r ^= np.where(r >> np.uint32(bit) & np.uint32(1), np.uint32(_POLY << (bit - 11)), np.uint32(0)).astype(np.uint32)
    return r


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits, and the coset leader of each syndrome."""
    leaders = np.zeros(2048, np.uint32)
    bits = [1 << i for i in range(23)]
    errors = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
    e = np.array(errors, np.uint32)
    leaders[_syndromes(e)] = e
    return _syndromes(np.arange(4096)), _syndromes(np.arange(2048) << 12), leaders


_LOW, _HIGH, _LEADER = _tables()


def golay_index(segments: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word (systematic: its high 12 bits)."""
    s = segments.astype(np.uint32)
    return (s ^ _LEADER[_LOW[s & np.uint32(0xFFF)] ^ _HIGH[s >> np.uint32(12)]]) >> np.uint32(11)


_FLIPS = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])


def neighbour_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 65) midpoints of n unsigned fingerprints, and the codeword triple of each as one number."""
    z = fps[:, None] ^ _FLIPS[None, :]
    key = np.zeros(z.shape, np.uint64)
    for shift, bits in SEGMENTS:
        seg = (z >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        key = key << np.uint64(12) | golay_index(seg).astype(np.uint64)
    return z, key


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a whole text: a bit is set if it is set in over half the shingle hashes.

    A-Z is lower-cased; words are runs of characters other than ASCII white space; shingles are k words
    joined by a space, repeats included. Fewer words: one shingle of them all. No words or null: zero.
    """
    return _fingerprint(shingle_hashes(text, k)[1])


def shingle_hashes(text: str | None, k: int) -> tuple[bytes, np.ndarray]:
    """The words joined by a space, and the hashes of all shingles in order; words and shingles as in ``fingerprint``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return joined, np.array([digest(joined, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *(ends[: -k].tolist())]
    return joined, np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(words) - k + 1)


def _fingerprint(h: np.ndarray) -> int:
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0].item()


def _columns(batch: pa.RecordBatch, values: np.ndarray, name: str) -> pa.RecordBatch:
    arrays = [*(batch.column(i) for i in range(1, batch.num_columns)), pa.array(values)]
    return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[1:], name])


def with_fingerprint(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "fp", k: int = SHINGLE) -> DataFrame:
    """``keep`` columns and the fingerprint as a long; texts stay in the task that read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _columns(b, np.fromiter((fingerprint(t, k) for t in b.column(0).to_pylist()), np.int64, b.num_rows), out)

    src = df.select(F.col(text).cast("string").alias("__text"), *keep)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:]]
    return src.mapInArrow(run, ", ".join([*fields, f"`{out}` bigint"]))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp -> (fp, key), each different key once."""
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i in range(0, len(fps), 4096):
            part = fps[i : i + 4096]
            key = np.sort(neighbour_keys(part.view(np.uint64))[1], axis=1)
            new = np.ones(key.shape, bool)
            new[:, 1:] = key[:, 1:] != key[:, :-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, new.sum(axis=1))), pa.array(key[new].view(np.int64))], names=["fp", "key"])


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, key) -> (fp, mid) for the neighbours of fp that decode to key."""
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        keys = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for i in range(0, len(fps), 4096):
            part = fps[i : i + 4096]
            z, key = neighbour_keys(part.view(np.uint64))
            hit = key == keys[i : i + 4096, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, hit.sum(axis=1))), pa.array(z[hit].view(np.int64))], names=["fp", "mid"])


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Stars ``(a, b)`` whose components are those of all fingerprint pairs at two or fewer differing bits.

    ``fps`` has a column ``fp`` without repeats.
    """
    near = _near(fps, scratch)
    group = near.groupBy("mid").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    return group.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def _near(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """``fp`` and ``mid``, the neighbours that decode to a key which another fingerprint has too."""
    keyed = fps.select("fp").mapInArrow(_keys, "fp bigint, key bigint")
    shared = scratch.save(keyed.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("key"), "keys")
    return keyed.join(shared, "key", "left_semi").select("fp", "key").mapInArrow(_midpoints, "fp bigint, mid bigint")


def near_buckets(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``band`` and ``id`` of the ``nodes (id, fp)``: all whose fingerprints differ in two bits or fewer share a bucket.

    A bucket is a midpoint of two or more fingerprints, or a fingerprint of two or more nodes.
    """
    fps = scratch.save(nodes.groupBy("fp").agg(F.count("*").alias("m")), "fps")
    near = scratch.save(_near(fps, scratch).distinct(), "mids")
    shared = near.groupBy("mid").agg(F.count("*").alias("m")).where("m > 1").select("mid")
    met = near.join(shared, "mid").unionByName(fps.where("m > 1").select("fp", F.col("fp").alias("mid"))).distinct()
    return nodes.select("id", "fp").join(met, "fp").select(F.xxhash64(F.lit("simhash"), "mid").alias("band"), "id")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """One row per input row: ``id_col``, ``fp`` (signed long), ``component_id`` (least id reachable).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows share a component.
    Rows whose id is null keep their row; a component of such rows only has a null ``component_id``. Other
    columns of ``df`` are not read, so their names cannot clash. An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    fp = scratch.save(with_fingerprint(df.select(F.col(id_col).alias("__id"), F.col(text).alias("__t")), "__t", ("__id",), "fp", k), "fp")
    reps = scratch.save(fp.groupBy("fp").agg(F.min("__id").alias("first")), "reps")
    comp = components(links(reps, scratch), scratch)
    member = reps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    member = scratch.save(member, "member")
    least = scratch.save(member.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = scratch.save(member.join(least, "root").select("fp", "component_id"), "named")
    return fp.join(named, "fp").select(F.col("__id").alias(id_col), "fp", "component_id")


def _row_keys(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str | None = None) -> DataFrame:
    """``id``, ``t`` (the text), and ``r1``, ``r2``: 128 bits over all columns of a row, which only rows alike in all share.

    ``keep`` names a struct of the whole row. Nothing else of ``df`` comes along, so names cannot clash.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    marked = [x for c in cols for x in (c, c.isNull())]
    row = [F.struct(*cols).alias(keep)] if keep else []
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("t"), F.xxhash64(F.lit(1), *marked).alias("r1"), F.xxhash64(F.lit(2), *marked).alias("r2"), *row)


def _one_each(df: DataFrame, rows: DataFrame, comp: DataFrame, node: str, scratch: Scratch, id_col: str, text: str) -> DataFrame:
    """One row of ``df`` for each component: of its rows in ``rows`` the one with the least id, null last.

    Rows with one id are told apart by ``node``, then by the hash of the row, so that a retry picks the same.
    """
    named = rows.join(comp.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", node, "r1", "r2")
    first = scratch.save(named.groupBy("root").agg(F.min(order).alias("at")).select("at.r1", "at.r2"), "first")
    scratch.free_but(first)
    kept = _row_keys(df, id_col, text, keep="row").join(first, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"])
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns))


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """The rows of ``df`` that stand for their group of near copies: one row for each component.

    The row with the least id stays. Ids are no keys: rows whose id is null or repeated are grouped by their
    texts like all others. Columns are those of ``df``.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    rows = scratch.save(with_fingerprint(_row_keys(df, id_col, text), "t", ("id", "r1", "r2"), "fp", k), "rows")
    comp = scratch.save(components(links(rows.select("fp").distinct(), scratch), scratch), "components")
    return _one_each(df, rows, comp, "fp", scratch, id_col, text)


_ODD = np.random.default_rng(SEED).integers(0, 1 << 64, ROWS * BANDS, np.uint64) | np.uint64(1)


def shingle_set(text: str | None, k: int) -> tuple[bytes, np.ndarray]:
    """The words joined by a space, and the hashes of the different shingles, sorted; words as in ``fingerprint``."""
    joined, h = shingle_hashes(text, k)
    return joined, np.unique(h)


def band_keys(hashes: np.ndarray) -> list[int]:
    """``BANDS`` keys, each of ``ROWS`` minima; texts at a similarity of s share one with 1 - (1 - s^ROWS)^BANDS."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[i : i + 4096, None] * _ODD).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[b].tobytes(), b) - (1 << 63) for b in range(BANDS)]


def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(text, id and row hash) -> (id and row hash, node, n, fp, bands); a text without words has no bands."""
    for b in batches:
        node, n, fp, bands = [], [], [], []
        for t in b.column(0):  # one text at a time is a Python string
            joined, every = shingle_hashes(t.as_py(), k)
            h = np.unique(every)
            node.append(xxhash.xxh3_128_digest(joined))
            n.append(len(h))
            fp.append(_fingerprint(every) if len(h) else 0)
            bands.append(band_keys(h) if len(h) else [])
        arrays = [*(b.column(i) for i in range(1, b.num_columns)), pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names[1:], "node", "n", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(text, id) -> (id, h)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            h = [shingle_set(t, k)[1].view(np.int64) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(h, pa.list_(pa.int64()))], names=["id", "h"])


def keep_one_alike(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """As ``keep_one``, with texts linked if the Jaccard similarity of their shingle sets reaches ``threshold``.

    Candidates are all texts whose fingerprints differ in at most two bits, by their Golay keys (``near_buckets``). At a
    similarity of 0.8 about 10 of 64 bits differ, a distance that Golay keys do not span and that texts with nothing in
    common come near, so MinHash keys name further candidates. Each is verified by the sets themselves; the
    buckets are settled in rounds (``line_dedup.settle``), so that no candidate is left out.
    Texts with the same words are one node, and texts without words (null and empty ones) another. Ids are no keys, as
    in ``keep_one``; texts of any length are read whole; columns, whatever their names, are those of ``df``; an empty
    table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "alike")
    keyed = _row_keys(df, id_col, text).select(F.col("t").cast("string").alias("t"), "id", "r1", "r2")
    kind = keyed.schema["id"].dataType.simpleString()
    rows = scratch.save(keyed.mapInArrow(lambda it: _signed(it, k), f"id {kind}, r1 bigint, r2 bigint, node binary, n bigint, fp bigint, bands array<bigint>"), "rows")
    node = rows.groupBy("node").agg(F.first("n").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min(F.struct("r1", "r2")).alias("at"))
    node = scratch.save(node.withColumnRenamed("node", "id"), "nodes")
    banded = node.select("id", "size", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band")
    close = near_buckets(node.where("size > 0"), scratch).join(node.select("id", "size"), "id")
    member = scratch.save(banded.join(shared, "band").select("band", "id", "size").unionByName(close.select("band", "id", "size")), "members")
    at = node.join(member.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("node"), "at.r1", "at.r2")
    texts = keyed.join(at, ["r1", "r2"]).dropDuplicates(["r1", "r2"]).select("t", F.col("node").alias("id"))
    sets = scratch.save(texts.mapInArrow(lambda it: _sets(it, k), "id binary, h array<bigint>"), "sets")

    def alike(pairs: DataFrame) -> DataFrame:
        x = pairs.join(sets.select(F.col("id").alias("a"), F.col("h").alias("x")), "a")
        xy = x.join(sets.select(F.col("id").alias("b"), F.col("h").alias("y")), "b")
        n = xy.select("a", "b", F.size("x").alias("x"), F.size("y").alias("y"), F.size(F.array_intersect("x", "y")).alias("common"))
        return n.where(F.col("common") >= threshold * (F.col("x") + F.col("y") - F.col("common"))).select("a", "b")

    elements = lambda ids: sets.join(ids, "id", "left_semi").select("id", F.explode("h").alias("h"))
    near = F.least("size", "p_size") >= threshold * F.greatest("size", "p_size")
    comp = scratch.save(settle(member, scratch, near, alike, elements, threshold), "components")
    return _one_each(df, rows, comp, "node", scratch, id_col, text)


def to_hex(col):
    return F.lower(F.lpad(F.hex(col), 16, "0"))
