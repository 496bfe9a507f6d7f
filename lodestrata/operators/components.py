"""Connected components of an edge table, and dense numbers within keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.shared import Steps


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which null ones meet each other."""
    other = right.withColumnsRenamed({k: f"{k}_right_" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(other[f"{k}_right_"])
    return left.join(other, on, how).drop(*(f"{k}_right_" for k in keys))


def hub_edges(named: DataFrame, keys: list[str], node: str) -> DataFrame:
    """(a, b): every node of (keys, node) linked with the least node of its keys,
    a star in place of all pairs."""
    hub = named.groupBy(*keys).agg(F.min(node).alias("b"))
    return meet(named, hub, keys).select(F.col(node).alias("a"), "b").where("a != b").distinct()


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """(node, component): the least node that can be reached, for all nodes of
    edges (a, b). Each round hangs every node's larger neighbours on its least
    one, then the smaller ones; the rounds grow with the logarithm of the number
    of nodes. Loops and nulls are left out."""

    def least(d: DataFrame) -> DataFrame:
        return d.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "at")

    now = steps.keep(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (state := tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())) != before and state[0]:
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours go to the least one of the node and its neighbours
        large = both.where("b > a").join(least(both).select("at", F.least("at", "m").alias("m")), F.col("a") == F.col("at")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = least(large)
        small = large.join(down, F.col("a") == F.col("at")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = steps.keep(small.unionByName(down.select(F.col("at").alias("a"), F.col("m").alias("b"))).distinct())
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, steps: Steps) -> DataFrame:
    """``name`` counts from 0 within keys by order. Rows are sorted over all
    tasks, so that a key may hold any number of them."""
    placed = steps.keep(rows.repartitionByRange(*keys, *order).withColumn("part_", F.spark_partition_id()))
    per = placed.groupBy(*keys, "part_").agg(F.count(F.lit(1)).alias("n_"))
    before = per.withColumn("before_", F.sum("n_").over(Window.partitionBy(*keys).orderBy("part_")) - F.col("n_")).drop("n_")
    at = F.row_number().over(Window.partitionBy(*keys, "part_").orderBy(*order)) - 1
    return meet(placed.withColumn("at_", at), before, [*keys, "part_"]).withColumn(name, F.col("before_") + F.col("at_")).drop("part_", "at_", "before_")


def listed(rows: DataFrame, by: str, value: str, order: Column, name: str) -> DataFrame:
    """(by, name): the distinct values of each group in the order of their first rows."""
    first = rows.groupBy(by, value).agg(F.min(order).alias("first_"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("first_", value))), lambda x: x[value]).alias(name))
