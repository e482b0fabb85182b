"""Best-fit packing of documents into fixed-length sequences by an island grouping genetic algorithm.

Documents of equal length are interchangeable, so the algorithm works on the histogram of piece lengths -
at most ``capacity`` rows whatever the corpus - and a chromosome is a list of groups (bin pattern, how many
bins have it). Crossover injects whole well-filled bins of one parent into the other, removes the bins whose
documents then occur twice, and best-fits the displaced documents. Islands are Spark tasks that evolve their
own populations from their own seeds; between epochs the best chromosome migrates to all islands. The
finished plan, again bounded by the histogram, tells each piece its sequence and place from its rank among
the pieces of its length; ranks come from counts by task and length, so no length is gathered anywhere.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ChunkCache
from .common import Scratch

CAPACITY, END_ID = 2048, 0
Plan = list[tuple[tuple[int, ...], int]]


# -- chromosomes -----------------------------------------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int, order: list[int] | None = None) -> Plan:
    """Best fit of ``counts[length]`` pieces, longest length first or in the given order.

    A piece goes to the fullest bin that still takes it. Bins of one content move together, so the work
    grows with the number of different lengths, not with the number of pieces.
    """
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # sorted, each once

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((content, n))

    for length in order if order is not None else sorted(counts, reverse=True):
        left = counts.get(length, 0)
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fit = capacity // length
                if full := left // fit:
                    put(capacity - fit * length, (length,) * fit, full)
                if left := left % fit:
                    put(capacity - left * length, (length,) * left, 1)
                break
            room = rooms[at]
            content, n = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
            fit = room // length
            use = min(n, left // fit)
            if use:
                put(room - fit * length, content + (length,) * fit, use)
                left -= use * fit
            if use < n:
                if not use:
                    put(room - left * length, content + (length,) * left, 1)
                    left, use = 0, 1
                if n > use:
                    put(room, content, n - use)
    return [g for gs in open_bins.values() for g in gs]


def bins(plan: Plan) -> int:
    return sum(n for _, n in plan)


def bound(counts: dict[int, int], capacity: int) -> int:
    """No plan has fewer bins: the tokens' bound, or the number of pieces over half a bin."""
    return max(-(-sum(k * n for k, n in counts.items()) // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))


def fitness(plan: Plan, capacity: int) -> tuple[int, float]:
    """Fewer bins, then fuller ones (sum of squared fills): smaller is better."""
    return bins(plan), -sum(n * (sum(c) / capacity) ** 2 for c, n in plan)


def _take(plan: Plan, left: Counter) -> Plan:
    """As many bins of each group as the pieces left allow; the others' pieces are displaced."""
    got = []
    for content, n in plan:
        need = Counter(content)
        if n := min(n, *(left[k] // v for k, v in need.items())):
            got.append((content, n))
            for k, v in need.items():
                left[k] -= v * n
    return got


def crossover(a: Plan, b: Plan, counts: dict[int, int], capacity: int, rng: random.Random) -> Plan:
    """Inject b's well-filled bins into a: the bins of a that then hold a piece twice go, their other pieces
    are displaced and best-fitted."""
    least = rng.choice((1.0, 1.0, 0.999, 0.99))
    left = Counter(counts)
    good = [(c, max(1, int(n * rng.uniform(0.5, 1)))) for c, n in b if sum(c) >= least * capacity and rng.random() < 0.7]
    child = _take(good, left)
    rest = sorted(a, key=lambda g: -sum(g[0]))
    cut = rng.uniform(0.9, 1)
    child += _take([g for g in rest if sum(g[0]) >= cut * capacity], left)
    return child + best_fit(+left, capacity, _order(left, rng))


def mutate(plan: Plan, counts: dict[int, int], capacity: int, rng: random.Random) -> Plan:
    """Open a share of the bins, the emptier ones first, and best-fit their pieces anew."""
    left = Counter(counts)
    keep = _take([(c, n) for c, n in plan if sum(c) == capacity and rng.random() < 0.8], left)
    return keep + best_fit(+left, capacity, _order(left, rng))


def _order(left: Counter, rng: random.Random) -> list[int]:
    wobble = rng.choice((0, 0, 0.02, 0.1))
    return sorted((k for k, v in left.items() if v > 0), key=lambda k: -k * (1 + wobble * rng.random()))


def evolve(counts: dict[int, int], capacity: int, seed: int, start: Plan | None, population: int, generations: int) -> Plan:
    """One island for one epoch: the best chromosome it found.

    Fitness counts bins first and how unevenly they are filled then, so that at the least number of bins evolution still
    gathers the free room in few of them.
    """
    rng = random.Random(seed)
    herd = [start or best_fit(counts, capacity)]
    key = lambda p: fitness(p, capacity)
    while len(herd) < population:
        herd.append(best_fit(counts, capacity, _order(Counter(counts), rng)))
    for _ in range(generations):
        herd.sort(key=key)
        a, b = rng.sample(herd[: max(2, population // 2 + 1)], 2)
        child = crossover(a, b, counts, capacity, rng) if rng.random() < 0.8 else mutate(a, counts, capacity, rng)
        if key(child) < key(herd[-1]):
            herd[-1] = child
    return _merged(min(herd, key=key))


def _merged(plan: Plan) -> Plan:
    total: Counter = Counter()
    for content, n in plan:
        total[tuple(sorted(content, reverse=True))] += n
    return sorted(total.items())


def islands(spark, counts: dict[int, int], capacity: int, n_islands: int = 6, epochs: int = 2, population: int = 6, generations: int = 12) -> Plan:
    """Evolve islands as Spark tasks; after each epoch the elite migrates to all of them. Every epoch runs, also where best
    fit has met the bound already.

    Histogram and plan are the only things sent, both bounded by ``capacity``; a lost task evolves the same
    island again from its seed.
    """
    best = _merged(best_fit(counts, capacity))
    for epoch in range(epochs):

        def run(batches: Iterator[pa.RecordBatch], best=best, epoch=epoch) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in b.column(0).to_pylist():
                    plan = evolve(counts, capacity, epoch * 1000 + i, best, population, generations)
                    yield pa.RecordBatch.from_pylist([{"content": list(c), "n": n, "island": i} for c, n in plan], schema=pa.schema([("content", pa.list_(pa.int32())), ("n", pa.int64()), ("island", pa.int64())]))

        rows = spark.range(0, n_islands, 1, n_islands).mapInArrow(run, "content array<int>, n bigint, island bigint")
        found: dict[int, Plan] = {}
        for r in rows.toLocalIterator():  # islands x patterns; a group of equal bins splits at most once for each length
            found.setdefault(r.island, []).append((tuple(r.content), r.n))
        best = min([best, *(found[k] for k in sorted(found))], key=lambda p: fitness(p, capacity))
    return best


# -- pieces ------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _encoder(path: str | None) -> ChunkCache:
    return ChunkCache(path)


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length): whole if it fits; else full pieces behind a first one of the remainder."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def with_pieces(df: DataFrame, id_col: str, text: str, capacity: int, vocabulary: str | None) -> DataFrame:
    """Token pieces of every text with their task (``part``) and rank among the task's pieces of the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = _encoder(vocabulary), Counter()
        end = END_ID.to_bytes(4, "little")
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            parts = b.column(1).to_pylist()
            for doc, part, raw in zip(ids, parts, enc.encode_bytes([t or "" for t in b.column(2).to_pylist()])):
                raw += end
                for piece, (start, length) in enumerate(pieces_of(len(raw) // 4, capacity)):
                    rows.append((doc, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    src = df.select(F.col(id_col).alias("id"), F.spark_partition_id().alias("part"), F.col(text).cast("string").alias("t"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint")


def _slots(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, first bin, bins, offset) of its runs: one run for each place in a pattern."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    base, used = 0, Counter()
    for content, n in plan:
        offset = 0
        for length in content:
            runs.setdefault(length, []).append((used[length], base, n, offset))
            used[length] += n
            offset += length
        base += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in runs.items()}


def pack(df: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, **ga) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Texts of any length are cut, only if longer than ``capacity``;
    repeated rows and equal texts are packed each for itself. Null ids are kept. Columns other than the id
    and the text are not read. An empty table gives an empty result.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "packing")
    pieces = scratch.save(with_pieces(df, id_col, text, capacity, vocabulary), "pieces")
    counts = scratch.save(pieces.groupBy("part", "length").agg(F.max("rank").alias("top")).select("part", "length", (F.col("top") + 1).alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    plan = islands(spark, histogram, capacity, **ga) if histogram else []
    return _placed(pieces, counts, plan).withColumnRenamed("id", id_col)


def _placed(pieces: DataFrame, counts: DataFrame, plan: Plan) -> DataFrame:
    slots = _slots(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy() + b.column("before").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length).tolist():
                at = np.flatnonzero(length == k)
                first, base, _, offset = slots[k]
                run = np.searchsorted(first, rank[at], side="right") - 1
                seq[at], off[at] = base[run] + rank[at] - first[run], offset[run]
            keep = [b.column(n) for n in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # Ranks over all tasks: the counts of earlier tasks, at most one row for each task and length.
    spark = pieces.sparkSession
    before = Scratch(spark, "packing-before").save(counts.select("part", "length", (F.sum("n").over(_running()) - F.col("n")).alias("before")), "before")
    # A row for each task and length grows with the input: never broadcast.
    joined = pieces.join(before.hint("merge"), ["part", "length"])
    kind = pieces.schema["id"].dataType.simpleString()
    return joined.select("id", "piece", "start", "length", "ids_crc32", "rank", "before").mapInArrow(place, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def _running():
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
