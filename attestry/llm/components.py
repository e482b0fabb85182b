"""Connected components by distributed union-find over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)`` for every node with a smaller one in its component.

    ``root`` is the smallest node of the component; roots themselves and nodes without edges are not
    listed. Each round is one large-star step (every edge child -> parent jumps to the parent's least
    parent) and one small-star step (a child's other parents are hung under its least parent), the
    alternating algorithm of Kiveris et al. Neither step gathers a node's neighbours: both use a minimum
    (pre-aggregated before the shuffle) and an equi-join whose sides are plain written tables, so that
    adaptive execution can split the partition of a hub. Rounds grow with the logarithm of the longest
    chain. Each round's table replaces the last in the shared folder.

    Nulls in either column are no edge. An empty table gives an empty result. Self-edges are ignored.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    e = scratch.save(pairs.select(F.greatest("a", "b").alias("c"), F.least("a", "b").alias("p")).distinct(), "edges")
    state = _state(e)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        least = scratch.save(e.groupBy("c").agg(F.min("p").alias("m")), "least")
        jumped = e.join(least.select(F.col("c").alias("p"), "m"), "p", "left").select("c", F.coalesce("m", "p").alias("p"))
        mine = e.join(least, "c").where("p <> m").select(F.col("p").alias("c"), F.col("m").alias("p"))
        new = scratch.save(jumped.unionByName(mine).where("c <> p").distinct(), "edges")
        seen = _state(new)
        scratch.free(e, least)
        e = new
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return e.groupBy(F.col("c").alias("node")).agg(F.min("p").alias("root"))


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("c", "p")), F.count_distinct("c")).first())
