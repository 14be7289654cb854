"""Intermediate tables in the folder that the whole cluster shares.

An operator that reads a result twice, or iterates, writes it here and reads it back: the lineage is cut and a lost
executor costs no recomputation. The folder is the session's ``spark.checkpoint.dir``; where that is unset, a session on
one machine (tests) gets a temporary folder, and any other is refused.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the cluster's shared scratch folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = tempfile.mkdtemp(prefix="memspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/memspark-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table of its own in the shared folder, and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a partition that an aggregate, a sort or a join holds in memory, about.
PARTITION_ROWS = 250_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of ``rows`` rows by ``keys`` in as many partitions as its rows need, whatever the session's number: a task's memory doesn't grow with the table."""
    return df.repartition(max(1, -(-rows // PARTITION_ROWS)), *keys)


def released(df: DataFrame) -> None:
    """Deletes the stored table ``df``, for rounds whose results the next one has replaced; nothing may read it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(spark: SparkSession) -> None:
    """Deletes the tables that this application has stored, for when its results are written; what reads them fails from then on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
