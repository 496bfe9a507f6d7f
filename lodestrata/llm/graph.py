"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("a_"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("a_")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("a_"), "m")
    rest = edges.join(least, F.col("a") == F.col("a_")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select(F.col("a_").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an
    edge (a, b). Loops and nulls are left out; repeated edges count once.

    Each round sends every node's larger neighbours, then its smaller ones, to
    the least of them; the number of rounds grows with the logarithm of the
    number of nodes. Every round is a written table, and the last one dropped.
    """
    now = scratch.keep(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or tuple(seen) == mark:
            break
        mark = tuple(seen)
        after = scratch.keep(_small_star(_large_star(now)))
        scratch.drop(now)
        now = after
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
