"""Connected components of a distributed list of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut

#: Rounds after which the loop counts as broken; as each shortens every tree, no list of links comes near it.
ROUNDS = 64


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = ROUNDS) -> DataFrame:
    """(node, root) for every node of ``links`` that is not its component's least node, ``root``; ids are long.

    Null ends, loops and repeated links don't matter. Every round groups by node with partial aggregation and is written
    to the shared folder; links never reach the driver. RuntimeError if ``rounds`` don't suffice.
    """
    tally = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = cut(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct())
    state = tally(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: neighbours above a node hang on the least of its neighbourhood.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its lower neighbours hang on the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        following = cut(small)
        # At the end every node hangs on its root alone and no root hangs on anything: two steps change nothing then.
        before, state = state, tally(following)
        if state == before:
            break
        edges = following
    else:
        raise RuntimeError(f"components: links still change after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
