"""Tables between the steps of an operator, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one gets its own folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestrata-"))
    return spark.sparkContext.getCheckpointDir()


class Steps:
    """Written tables that cut lineage and survive lost executors. What ``last``
    returns is all that stays until the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        if not self.count:
            atexit.register(self._clear, self.folder)
        self.count += 1
        df.write.parquet(f"{self.folder}/{self.count}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.count}")

    def last(self, df: DataFrame) -> DataFrame:
        out = self.keep(df)
        for i in range(1, self.count):
            self._clear(f"{self.folder}/{i}")
        return out

    def _clear(self, path: str) -> None:
        with contextlib.suppress(Exception):  # the session may have ended
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
