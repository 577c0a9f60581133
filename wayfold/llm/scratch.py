"""Intermediate tables in the folder that every executor shares."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset a folder of the warehouse, which executors share as well. No machine's own folder is used."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch").rstrip("/")


#: Tables after which unused plans and shuffles are released.
EVERY = 4


class Scratch:
    """Cuts lineage by writing tables. drop() deletes those that no later step and no result reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.saved = spark, shared_dir(spark), 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.saved += 1
        if self.saved % EVERY == 0:
            self.release()
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path  # kept on the table itself, so that no table is held longer than its user holds it
        return out

    def release(self) -> None:
        """Lets the driver forget plans, broadcasts and shuffles that nothing uses any more.

        Spark deletes a shuffle's files only when the driver's collector finds it unused; plans are held by Python's side until
        its own collector has run.
        """
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "scratch_path", None):
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
