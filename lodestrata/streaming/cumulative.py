"""Entity tables that grow with every micro-batch (J4 as a stream).

A batch's merged state is written as a version of its own, named by the batch.
A batch that runs again starts from the version before it and writes the same
rows, so a restart neither loses nor repeats anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from lodestrata.operators.entities import merge_entities

COLUMNS = ("topic", "kind", "ord", "canonical", "variants", "hint", "category")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The batches whose state is written whole."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    done = lambda p: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(place) if s.getPath().getName().startswith("v-") and done(s.getPath()))


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest state, or the newest of a batch before ``before``."""
    known = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/v-{known[-1]}") if known else None


def merged_into(path: str):
    """What foreachBatch calls: the batch's entities merged into the last state."""

    def merge(batch: DataFrame, number: int) -> None:
        prior = latest(batch.sparkSession, path, number)
        rows = batch.select(*COLUMNS).withColumn("is_fresh", F.lit(True))
        if prior is not None:
            rows = rows.unionByName(prior.select(*COLUMNS).withColumn("is_fresh", F.lit(False)))
        merge_entities(rows).write.mode("overwrite").parquet(f"{path}/v-{number}")

    return merge


def start(entities: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merge a stream of entities into the state at ``path``, until all that is there is read."""
    return entities.writeStream.foreachBatch(merged_into(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """The rows of every batch, as they are reported."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows.append((event.progress.batchId, event.progress.numInputRows))

    def onQueryTerminated(self, event) -> None:
        pass
