"""Where intermediate tables go: always the folder that every executor and the driver share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without one (tests) gets a temporary folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='kairoframe-')}")
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    return str(jvm_dir.get()).rstrip("/")


ROWS_PER_BATCH = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts travel to Python in Arrow batches, which exist on both sides at once. Spark counts their rows, 10,000 by default; operators
    on texts lower that for the session, unless it is lower already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_PER_BATCH:
        spark.conf.set(name, str(ROWS_PER_BATCH))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kairoframe/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: the lineage is cut, and a lost executor costs
    only the tasks that it was running. The files stay until the cluster clears its checkpoint folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(*tables: DataFrame) -> None:
    """Delete the files below tables made by write_shared, once nothing reads them any more."""
    for df in tables:
        _drop(df)


def _drop(df: DataFrame) -> None:
    spark = df.sparkSession
    root = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if "/kairoframe/" in folder and root.split("://")[-1].lstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
