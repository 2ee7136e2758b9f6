"""Folders that driver and executors share, for files that are written and read again."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, label: str) -> str:
    """A fresh folder under spark.checkpoint.dir; where that is unset and everything runs on one machine, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skyplume-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/skyplume/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, its lineage cut."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared(spark, "checkpoints"))
    return df.checkpoint(eager=True)


def parameter_hash(parameters: dict, digits: int = 8) -> str:
    """The first hexadecimal digits of the MD5 of the parameters as JSON with sorted keys."""
    return hashlib.md5(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:digits]


def kept(spark: SparkSession, folder: str, name: str, parameters: dict, make) -> DataFrame:
    """A table made once for each set of parameters: read if it is there, else made by ``make()`` and written."""
    path = f"{folder}/{name}-{parameter_hash(parameters)}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
