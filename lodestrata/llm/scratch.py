"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where none is set a local
    session gets a folder of its own; on a cluster, whose machines would not
    see each other's folders, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestrata-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Parquet tables that cut lineage and survive lost executors. Each call of
    an operator has its own; it drops what its result no longer needs, and what
    is left, the small tables that a lazy result reads, goes with ``close`` or
    when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/scratch-{uuid.uuid4().hex}"
        self.made: dict[str, None] = {}
        self.count = 0
        atexit.register(self.close)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return the written table."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        self.made[path] = None
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            delete(self.spark, df._scratch_path)
            self.made.pop(df._scratch_path, None)

    def only(self, df: DataFrame) -> DataFrame:
        """Write ``df``, the last thing that reads this scratch, and drop all else."""
        before = [*self.made]
        out = self.keep(df)
        for path in before:
            delete(self.spark, path)
            del self.made[path]
        return out

    def close(self) -> None:
        """Delete all tables. For the one who has read the results."""
        atexit.unregister(self.close)
        with contextlib.suppress(Exception):  # the session may have ended
            if self.made:
                delete(self.spark, self.root)
        self.made.clear()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
