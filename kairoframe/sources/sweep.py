"""A sweep over a folder of files that may be broken: each file is a row, and a broken one costs only its own.

Files are read by Spark's binaryFile source, so paths of any store work, and parsed on the executors one at a time. Files of more than ``most_mb`` are not read at all but reported; parsing therefore holds one file of a
bounded size. The source passes over files of no bytes: they are found by their names, of which Spark's index holds all in the driver anyway, and reported too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Parse = Callable[[bytes], dict[str, Any]]


def swept(spark: SparkSession, folder: str, pattern: str, parse: Parse, schema: str, most_mb: int = 256) -> DataFrame:
    """path, bytes, ok, error and the columns of ``schema``, which parse returns for a file's content (null where it fails)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    small = F.col("length") <= most_mb << 20
    # The content of a file that is too long is never asked for: the source reads it only where the filter holds.
    readable, rest = files.where(small).select("path", "length", "content"), files.where(~small).select("path", "length")
    out_type = StructType.fromDDL(f"path string, bytes long, ok boolean, error string, {schema}")
    arrow = to_arrow_schema(out_type)
    names = arrow.names[4:]

    def one(path: str, length: int, content: bytes) -> list:
        try:
            found = parse(content)
            return [path, length, True, None, *(found.get(n) for n in names)]
        except Exception as e:  # noqa: BLE001  (whatever is wrong with a file is told, and the sweep goes on)
            return [path, length, False, f"{type(e).__name__}: {e}", *(None for _ in names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = one(*(batch.column(c)[i].as_py() for c in range(3)))
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

    too_long = rest.select("path", F.col("length").alias("bytes"), F.lit(False).alias("ok"), F.lit(f"longer than {most_mb} MB").alias("error"))
    names_of_all = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(f)),) for f in files.inputFiles()], "path string")
    empty = names_of_all.join(files.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("bytes"), F.lit(False).alias("ok"), F.lit("empty").alias("error"))
    return readable.mapInArrow(run, out_type).unionByName(too_long, allowMissingColumns=True).unionByName(empty, allowMissingColumns=True)
