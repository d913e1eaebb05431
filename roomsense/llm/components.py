"""Connected components of a graph given by its links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomsense.llm.common import written


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One star operation on links (x > y): neighbours are handed to the smallest of them.

    Only minima are aggregated, which combine before the shuffle; a node of many links is a join key whose
    partition can be split.
    """
    if small:
        out = links.select(F.col("x").alias("node"), F.col("y").alias("next"))
    else:
        out = links.select(F.col("x").alias("node"), F.col("y").alias("next")).unionByName(links.select(F.col("y").alias("node"), F.col("x").alias("next")))
    least = out.groupBy("node").agg(F.min("next").alias("least"))
    least = least.select(F.col("node").alias("of"), F.least("least", "node").alias("least"))
    if small:
        pairs = out.join(least, F.col("node") == F.col("of")).select(F.col("next").alias("x"), F.col("least").alias("y"))
        pairs = pairs.unionByName(least.select(F.col("of").alias("x"), F.col("least").alias("y")))
    else:
        pairs = out.where("next > node").join(least, F.col("node") == F.col("of")).select(F.col("next").alias("x"), F.col("least").alias("y"))
        # a node's link to its smallest neighbour stays
        pairs = pairs.unionByName(least.where("of > least").select(F.col("of").alias("x"), F.col("least").alias("y")))
    pairs = pairs.where("x > y")
    return pairs.distinct() if small else pairs   # minima do not mind repeats


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(x, y) in either order, repeats and loops allowed -> node, component (its smallest node), for every linked node.

    Alternates large and small stars until the links are stars round the smallest nodes; each round is written, so a
    lost executor repeats one round at most.  Null ends are ignored.
    """
    links = written(links.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "links")
    for _ in range(most_rounds):
        links = written(_star(_star(links, small=False), small=True), "links")
        # settled when all links are stars: no node has two smaller neighbours or is both centre and ray
        ends = links.select(F.col("x").alias("node"), F.lit(1).alias("ray"), F.lit(0).alias("centre"))
        ends = ends.unionByName(links.select(F.col("y").alias("node"), F.lit(0).alias("ray"), F.lit(1).alias("centre")))
        if ends.groupBy("node").agg(F.sum("ray").alias("ray"), F.max("centre").alias("centre")).where("ray > 1 or (ray = 1 and centre = 1)").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    found = links.groupBy("x").agg(F.min("y").alias("component"))
    return found.select(F.col("x").alias("node"), "component").unionByName(links.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())
