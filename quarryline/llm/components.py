"""Connected components by alternating large-star and small-star steps; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import gathered, split_join, written


def connected(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """`node`, `component` (smallest node reachable) for every node that has a link to another; `rows`: how many edges at most, if known.

    Each step keeps the components and moves every node closer to its smallest one, until the links are a set of stars:
    no node has two smaller ones, or a smaller and a greater one. A node is only ever joined with its minimum, by broadcast
    if it has very many links, so no task gathers its links. Steps never add links.
    """
    found = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    now = written(found if rows is None else gathered(found, rows), "edges")
    most = now.count()
    while most:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        smaller = F.count(F.when(F.col("v") < F.col("u"), 1))
        nodes = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("held"), smaller.alias("smaller"))
        least = written(gathered(nodes.select("u", F.least("u", "m").alias("m"), "held", "smaller"), 2 * most), "least")
        if least.where("smaller > 1 OR (smaller = 1 AND held > 1)").isEmpty():
            break
        large = split_join(both.where("v > u"), least.drop("smaller"), "u", 2 * most).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = written(gathered(large, most), "large")
        least = written(gathered(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("held")), most), "least")
        small = split_join(large, least, "hi", 2 * most).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()
        now = written(gathered(small, most), "small")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
