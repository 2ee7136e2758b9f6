"""Tables as text: formatted CSV, JSON objects, numbered frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyplume.functions.guards import is_finite


def formatted(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """``df`` as strings, numbers by printf ``formats``; null and non-finite numbers are blank."""
    return df.select(*[F.when(is_finite(F.col(c).cast("double")), F.format_string(formats[c], c)).otherwise("").alias(c) if c in formats else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, formats: dict[str, str]) -> None:
    """Writes ``formatted`` rows with a header, a file a task."""
    formatted(df, formats).write.option("header", True).option("emptyValue", "").csv(path)


def json_rows(df: DataFrame, keys: list[str], name: str = "json") -> DataFrame:
    """(keys, json): all other columns of a row as one object; numbers that JSON lacks become null, nulls stay as null."""
    rest = [f for f in df.schema.fields if f.name not in keys]
    safe = [F.when(is_finite(F.col(f.name)), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in rest]
    return df.select(*keys, F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias(name))


def numbered_frames(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``local`` (from 0 within a key, by ``order``) and the file name of that number."""
    local = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("local", local).withColumn("file", F.concat(F.lpad(F.col("local").cast("string"), 5, "0"), F.lit(".jpg")))
