"""Connected components of a link table, without ever gathering links.

Alternating large-star and small-star steps. Each step is a map-side-combined
minimum and a join on the node, so a node with very many links is an aggregate
(combined before the shuffle) and a join that Spark may split, never a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import cut

#: Rounds after which something is wrong: the steps converge in O(log^2 nodes).
MAX_ROUNDS = 60


def _lowered(links: DataFrame) -> DataFrame:
    """Links as (child, parent) with child > parent, each once."""
    return (
        links.select(F.greatest("src", "dst").alias("child"), F.least("src", "dst").alias("parent"))
        .filter("child > parent")
        .distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("child").alias("u"), F.col("parent").alias("v")).unionByName(
        links.select(F.col("parent").alias("u"), F.col("child").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("src"), F.least("u", "m").alias("dst"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("child").agg(F.min("parent").alias("m"))
    joined = links.join(least, "child")
    return joined.select(F.col("parent").alias("src"), F.col("m").alias("dst")).unionByName(
        least.select(F.col("child").alias("src"), F.col("m").alias("dst"))
    )


def _state(links: DataFrame) -> tuple:
    """Two numbers that stand for a set of links: it has converged when they stay."""
    return tuple(
        links.agg(
            F.count("*"), F.sum(F.xxhash64("child", "parent").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("child", "parent"))
        ).first()
    )


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest reachable node.

    ``links`` has comparable columns ``src`` and ``dst`` in any direction,
    repeats and self-links allowed. Rows with a null end are ignored. An empty
    table gives an empty table.
    """
    now = cut(_lowered(links.filter("src IS NOT NULL AND dst IS NOT NULL")))
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        now = cut(_lowered(_small_star(_lowered(_large_star(now)))))
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("child").alias("node"), F.col("parent").alias("root")).unionByName(
        now.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct()
    )
