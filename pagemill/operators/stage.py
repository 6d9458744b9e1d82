"""Results kept between the steps of an iterative job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagemill.session import use_checkpoint_dir


class Stage:
    """A folder below the shared checkpoint folder that holds one job's intermediate tables.

    A written table cuts the lineage, outlives lost executors, is computed once, and has a known
    size, by which Spark chooses how to join it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{use_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def save_clustered(self, rows: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """The same, bucketed and sorted by a key: one shuffle now, none in later joins on it."""
        table = f"{name}_{uuid.uuid4().hex}"
        rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option(
            "path", f"{self.root}/{name}"
        ).saveAsTable(table)
        return self.spark.table(table)

    def load(self, names: list[str], like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(*(f"{self.root}/{n}" for n in names))
