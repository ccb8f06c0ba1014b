"""Tables that several consumers read: written once in the folder that the cluster shares, bucketed and sorted, so that a consumer's windows need no shuffle of their own.

A lost executor costs the tasks it ran, for what was written stays. Files stay too, until ``close`` or until the cluster clears its checkpoint folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in that of spark.checkpoint.dir; only a local session without one gets a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='kairoframe-')}"
    return f"{root.rstrip('/')}/kairoframe-shared/{name}-{uuid.uuid4().hex}"


class SharedTables:
    """Bucketed tables by one key. As many buckets as the session has shuffle partitions, unless said otherwise."""

    def __init__(self, spark: SparkSession, key: str, order: list[str], buckets: int | None = None) -> None:
        self.spark, self.key, self.order = spark, key, order
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = shared_path(spark, "pass")
        self.names: list[str] = []

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        """rows, written now and read from the table from here on."""
        table = f"kairoframe_{name}_{uuid.uuid4().hex}"
        by = [self.key, *(c for c in self.order if c in rows.columns)]
        placed = rows.repartition(self.buckets, self.key).sortWithinPartitions(*by)
        placed.write.bucketBy(self.buckets, self.key).sortBy(*by).format("parquet").option("path", f"{self.path}/{name}").saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table)

    def close(self) -> None:
        """Forget the tables and delete their files."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
