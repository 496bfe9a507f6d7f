"""Tables that batches are committed to once: an append sink, and entities that age.

A batch writes its rows under its own number, then its entry in the manifest,
by which alone readers know it. A batch that runs again replaces its rows with
the same; one that ended before its entry is not seen. Old versions of a state
are deleted when the next two are committed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MANIFEST = "_manifest"
#: Entities that are verified again in each batch.
OLDEST = 2


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> list[int]:
    """The batches of the manifest, ascending."""
    place, fs = _files(spark, f"{path}/{MANIFEST}")
    if not fs.exists(place):
        return []
    return sorted(int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(place) if f.getPath().getName().endswith(".json"))


def commit(batch: DataFrame, number: int, path: str) -> None:
    """K5, K6: the rows of a batch, and then its entry. An entry is renamed into
    place, so that it is there whole or not at all."""
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    draft, fs = _files(spark, f"{path}/{MANIFEST}/{number}.draft")
    entry, _ = _files(spark, f"{path}/{MANIFEST}/{number}.json")
    if fs.exists(entry):
        return  # the same rows again
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"batch": number, "columns": batch.columns}).encode()))
    out.close()
    fs.rename(draft, entry)


def entries(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of committed batches; None before the first."""
    known = committed(spark, path)
    return spark.read.option("basePath", path).parquet(*(f"{path}/batch={n}" for n in known)) if known else None


def aged(state: DataFrame | None, batch: DataFrame, keys: list[str], at: int) -> DataFrame:
    """W1 over time: entities (keys, name, verified) after a batch (keys, name):
    names not known yet are verified now, and so are, of each key, the OLDEST
    that were verified longest ago, the smaller names first."""
    fresh = batch.select(*keys, "name").distinct().withColumn("verified", F.lit(at).cast("long"))
    both = fresh if state is None else fresh.unionByName(state.select(*keys, "name", "verified")).groupBy(*keys, "name").agg(F.min("verified").alias("verified"))
    # the oldest of a key by an aggregate that keeps so many rows a group, not by a window over all
    order = F.struct("verified", "name")
    first = both.groupBy(*keys).agg(F.min(order).alias("o1"))
    held = both.join(first, keys)
    second = held.where(order != F.col("o1")).groupBy(*keys).agg(F.min(order).alias("o2"))
    marked = held.join(second, keys, "left")
    again = (order == F.col("o1")) | F.coalesce(order == F.col("o2"), F.lit(False))
    return marked.select(*keys, "name", F.when(again, F.lit(at)).otherwise(F.col("verified")).cast("long").alias("verified"))


def ageing_into(path: str, keys: list[str]):
    """What foreachBatch calls: the state of the batch before, aged by this one.
    The two newest versions stay, so that the last batch can run again."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in committed(spark, path) if n < number]
        state = spark.read.parquet(f"{path}/batch={before[-1]}") if before else None
        commit(aged(state, batch, keys, number), number, path)
        for old in before[:-1]:
            for gone in (f"{path}/{MANIFEST}/{old}.json", f"{path}/batch={old}"):
                place, fs = _files(spark, gone)
                fs.delete(place, True)

    return step


def start_ageing(rows: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    return rows.writeStream.foreachBatch(ageing_into(path, keys)).option("checkpointLocation", checkpoint).start()


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    known = committed(spark, path)
    return spark.read.parquet(f"{path}/batch={known[-1]}") if known else None
