"""Connected components of a link table by alternating large and small stars, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.storage import discard, few, materialize, small


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)).cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, component): the least node that each linked node reaches. ``links`` has long columns u and v.

    Each round is one large star (every larger neighbour points to the least) and one small star (every smaller
    neighbour does); it ends when a round changes nothing, after about log(diameter) rounds. Loops and repeated links do
    no harm; nodes without links are not listed; an empty table gives an empty one. Rounds over few links take few tasks
    and join by broadcast. The result is a table in the shared folder.
    """
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    seen = _mark(edges)
    for _ in range(most_rounds):
        n = seen[0]
        if not n:
            break
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = few(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), 2 * n)
        large = few(both.filter("v > u").join(small(least, 2 * n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), n)
        # after a large star every link points from larger to smaller, so u's smaller neighbours are its v
        low = few(large.groupBy("u").agg(F.min("v").alias("m")), n)
        starred = large.join(small(low, n), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct()
        old, edges = edges, materialize(few(starred, 2 * n), "links")
        discard(old)
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    of = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out = materialize(few(of, 2 * seen[0]), "components")
    discard(edges)
    return out
