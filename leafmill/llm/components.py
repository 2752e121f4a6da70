"""Connected components of an edge table by alternating stars.

Each round only aggregates and joins on node ids, so no component, however
large, is gathered in one task: minima are pre-aggregated before the shuffle
and written, so the join that deals a star's rows by its centre meets two plain
shuffles, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._shared import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(u long, v long)`` edges -> ``(node long, root long)``, root being the least node reachable.

    Only nodes with an edge to another node appear. Null ends and loops are
    ignored; repeated edges count once; no edges give no rows.
    """
    a, b = F.least("u", "v").alias("b"), F.greatest("u", "v").alias("a")
    now = materialize(edges.where("u <> v").select(b, a).select("a", "b").distinct(), "edges")
    mark = _mark(now)
    if mark[0] == 0:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        star = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = materialize(star.distinct(), "edges")
        discard(now)
        discard(least)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
