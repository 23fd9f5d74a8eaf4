"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a folder of one's own only where it names none and Spark runs on one machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracewell-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """A table of its own in the shared folder: what several parts of a plan read is computed once, and lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
