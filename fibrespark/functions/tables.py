"""Tables that iterative operators write between their rounds, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session without it gets a temporary folder; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fibrespark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def merged(df: DataFrame) -> DataFrame:
    """``df``, whose next join is by sorted merge. The planner takes rows that ``explode`` makes, or that a join or a group leaves, for as few as the file they come from and would have the driver broadcast them."""
    return df.hint("merge")


class Rounds:
    """Writes the tables of one run: each cuts the lineage and survives lost executors. Those of past rounds are deleted by ``drop``, the rest when the session ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.paths: dict[int, str] = {}
        atexit.register(self.drop)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/fibrespark-{self.name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._rounds = self  # keeps the id from being given to another table
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes ``tables`` (all without any)."""
        for key in [id(t) for t in tables] or list(self.paths):
            path = self.paths.pop(key, None)
            try:
                if path:
                    place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                    place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            except Exception:  # the session has ended; whoever owns the folder clears it
                pass
