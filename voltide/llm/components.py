"""Connected components by alternating large-star and small-star steps.

Each round rewires every edge towards the smallest neighbour known; stars are
the fixed point. All steps are joins and partial aggregates on edges; nothing
is collected. Each round's edges are written to the shared folder, so a lost
executor costs one round at most, and the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.session import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): u's neighbours v. Large: both directions, link the larger
    neighbours to the smallest; small: link all smaller ones to the smallest."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = out.where("u != v")
    return out if large else out.distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest
    node of the component. Loops, repeats and empty input are fine."""
    scratch = Scratch(edges.sparkSession)
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = scratch.table(edges.where("u != v").select("u", "v").distinct(), "edges")
    before = mark(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        new = scratch.table(_star(_star(now, True), False), "edges")
        scratch.free(now)
        now, after = new, mark(new)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
