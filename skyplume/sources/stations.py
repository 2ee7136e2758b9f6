"""Weather stations: hourly CSV series, monthly HTML tables, the registry, and which files belong to which station.

Times are local wall-clock times without zone where the files have them so.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyplume.functions.guards import finite

#: Fixed value: metres per second in a knot.
KNOT = 0.514444


def number(text: Column) -> Column:
    """A decimal number with comma or point; NaN if it is blank or none."""
    return F.coalesce(F.regexp_replace(F.trim(text), ",", ".").try_cast("double"), F.lit(float("nan")))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """(file, ts, value) of semicolon CSVs ``YYMMDD;HHMM;value`` in Latin-1 with a header: decimal commas, a blank value is NaN.

    Lines with fewer than three fields or a blank date are skipped. Any other line
    whose date or hour is not a number means another kind of table (a wind rose)
    and is an error, as is a value that is no number. Of repeated times in a file
    the last line's value stays.
    """
    return _series(spark.read.option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "").option("header", True).schema("line string").csv(path).select("line", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_i")))


def series_of(files: DataFrame) -> DataFrame:
    """``read_series`` of files held as rows (path, content): many small ones, kept together."""
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split(F.decode("content", "ISO-8859-1"), "\r\n|\r|\n")).alias("_i", "line"))
    return _series(lines.filter("_i > 0 and line <> ''").select("line", "file", F.lit(0).alias("_block"), "_i"))


def _series(lines: DataFrame) -> DataFrame:
    """``read_series`` of (line, file, _block, _i) without headers."""
    f = F.split("line", ";", -1)
    day, hour = F.trim(f[0]), F.trim(f[1])
    rows = lines.filter((F.size(f) >= 3) & (day != "")).select("file", "_block", "_i", "line", day.alias("day"), hour.alias("hour"), F.trim(f[2]).alias("raw"))
    good = F.col("day").rlike("^[0-9]{6}$") & F.col("hour").rlike("^[0-9]{3,4}$")
    value = F.when(F.col("raw") == "", F.lit(float("nan"))).otherwise(F.regexp_replace("raw", ",", ".").try_cast("double"))
    part = lambda c, at, n: F.substring(c, at, n).cast("int")
    ts = F.make_timestamp_ntz(2000 + part("day", 1, 2), part("day", 3, 2), part("day", 5, 2), part("hour", 1, 2), F.expr("substring(hour, 3)").cast("int"), F.lit(0))
    wrong = lambda c: F.raise_error(F.concat(F.lit("not a time series: "), c)).cast("timestamp_ntz")
    out = rows.select("file", "_block", "_i", F.when(good & value.isNotNull(), ts).otherwise(wrong(F.col("line"))).alias("ts"), value.alias("value"))
    return out.groupBy("file", "ts").agg(F.max_by("value", F.struct("_block", "_i")).alias("value"))


def wind_series(direction: DataFrame, speed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ts, dir, vel) at the times that both series have."""
    return direction.select(*keys, "ts", F.col("value").alias("dir")).join(speed.select(*keys, "ts", F.col("value").alias("vel")), [*keys, "ts"])


class _Table(HTMLParser):
    """Cells of the first table of a page."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.depth, self.done, self.cell = 0, False, None

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif self.depth and tag == "tr":
            self.rows.append([])
        elif self.depth and tag in ("td", "th"):
            self.cell = ""

    def handle_endtag(self, tag):
        if self.depth and tag == "table":
            self.depth -= 1
            self.done = self.depth == 0
        elif self.depth and tag in ("td", "th") and self.cell is not None and not self.done:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(self.cell.strip())
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell += data


def first_table(page: str) -> tuple[list[str], list[list[str]]]:
    """Header and rows of the first table of a page; both empty without one."""
    parser = _Table()
    parser.feed(page)
    rows = [r for r in parser.rows if r]
    return ([c.lower() for c in rows[0]], rows[1:]) if rows else ([], [])


#: Fixed values of the file format: how the columns of a monthly table begin.
PREFIXES = ("fecha", "hora", "dd", "ff")


def read_months(spark: SparkSession, path: str) -> DataFrame:
    """``months_of`` the files under ``path``."""
    return months_of(spark.read.format("binaryFile").load(path))


def months_of(files: DataFrame) -> DataFrame:
    """(file, ts, dir, vel, unit) of HTML tables saved as spreadsheets (path, content): UTC times, knots turned to metres per second.

    Columns are found by prefix (``PREFIXES``), of several the last; a file
    without a table or one of the columns is an error. Rows without a valid time
    are dropped, numbers that can't be read are NaN.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                head, rows = first_table(bytes(content).decode("utf-8", "replace"))
                at = {p: k for p in PREFIXES for k, c in enumerate(head) if c.startswith(p)}
                if len(at) < len(PREFIXES):
                    raise ValueError(f"{name}: no columns {sorted(set(PREFIXES) - set(at))} in {head}")
                unit = "knots" if "kt" in head[at["ff"]] or "nudo" in head[at["ff"]] else "m/s"
                out += [(name, *(r[at[p]] if at[p] < len(r) else "" for p in PREFIXES), unit) for r in rows]
            yield pd.DataFrame(out, columns=["file", "day", "hour", "dd", "ff", "unit"])

    raw = files.select("path", "content").mapInPandas(run, "file string, day string, hour string, dd string, ff string, unit string")
    ts = F.try_to_timestamp(F.concat_ws(" ", "day", "hour"), F.lit("dd-MM-yyyy HH:mm")).cast("timestamp_ntz")
    vel = number(F.col("ff")) * F.when(F.col("unit") == "knots", KNOT).otherwise(1.0)
    return raw.select("file", ts.alias("ts"), number(F.col("dd")).alias("dir"), vel.alias("vel"), "unit").filter("ts is not null")


def joined_months(tables: DataFrame, keys: list[str]) -> DataFrame:
    """One row a time over monthly tables that overlap: that of the last file by name; ``misnamed`` marks rows of files whose name asks for a month that they don't have."""
    base = F.regexp_extract("file", "([^/]*)$", 1)
    asked = F.concat_ws("-", F.regexp_extract(base, r"(?<!\d)(20\d{2})[-_]?(0[1-9]|1[0-2])(?!\d)", 1), F.regexp_extract(base, r"(?<!\d)(20\d{2})[-_]?(0[1-9]|1[0-2])(?!\d)", 2))
    month = F.date_format("ts", "yyyy-MM")
    # A window over a file's rows (a month): a join would read each page twice.
    rows = tables.withColumn("misnamed", (asked != "-") & ~F.bool_or(month == asked).over(Window.partitionBy("file")))
    return rows.groupBy(*keys, "ts").agg(F.max_by(F.struct("dir", "vel", "misnamed"), "file").alias("_l")).select(*keys, "ts", "_l.*")


#: Fixed values of the file format: fields of a registry.
REGISTRY = "esquema string, estaciones array<struct<id:string,nombre:string,fuente:string,carpeta:string,patron:array<string>,patron_dir:array<string>,patron_vel:array<string>,lat:double,lon:double,alt:double,z_ref:double>>"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A row for each station of registry JSON files, ``folder`` its own or its id, and the schema version of its file; fields that a station lacks are null."""
    rows = spark.read.option("multiLine", True).schema(REGISTRY).json(path)
    return rows.select("esquema", F.explode("estaciones").alias("s")).select(F.col("esquema").alias("version"), F.col("s.id"), F.col("s.nombre").alias("name"), F.upper("s.fuente").alias("source"), F.coalesce("s.carpeta", "s.id").alias("folder"), F.col("s.lat"), F.col("s.lon"), F.col("s.alt"), F.col("s.z_ref"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of the files under ``path``; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def station_files(files: DataFrame, stations: DataFrame, patterns: dict[str, str], top: str, large: int = 50_000) -> DataFrame:
    """(id, kind, path, origin, place) of each station's files by kind, the newest first.

    ``patterns`` are regular expressions of file names, whatever their case.
    Files in the station's folder count; where it has none of a kind, loose files
    of the folder ``top`` whose name has the id's first part. Files of up to ``large``
    bytes are left out where a larger one is there. Ties by path.
    """
    from pyspark.sql import Window as W

    name, folder = F.regexp_extract("path", "([^/]*)$", 1), F.regexp_extract("path", "([^/]*)/[^/]*$", 1)
    kinds = F.array(*[F.when(name.rlike(f"(?i)^(?:{p})$"), F.lit(k)) for k, p in patterns.items()])
    f = files.select("path", "length", "modified", F.lower(name).alias("_name"), folder.alias("_folder"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))
    s = stations.select("id", "folder", F.lower(F.split("id", "_")[0]).alias("_first"))
    own = f.join(s, F.col("_folder") == F.col("folder")).select("id", "kind", "path", "length", "modified", F.lit("folder").alias("origin"))
    # A loose file belongs to the stations whose id's first part is a word of its name; only stations that lack a kind are asked.
    kind = F.explode(F.array(*[F.lit(k) for k in patterns])).alias("kind")
    lacking = s.select("id", "_first", kind).join(own.select("id", "kind").distinct(), ["id", "kind"], "left_anti")
    loose = f.filter(F.col("_folder") == top).withColumn("_word", F.explode(F.array_distinct(F.split("_name", "[^a-z0-9]+"))))
    loose = loose.join(lacking.withColumnRenamed("_first", "_word"), ["_word", "kind"]).select("id", "kind", "path", "length", "modified", F.lit("loose").alias("origin"))
    key = W.partitionBy("id", "kind")
    rows = own.union(loose).withColumn("_some", F.max("length").over(key) > large).filter((F.col("length") > large) | ~F.col("_some"))
    return rows.select("id", "kind", "path", "origin", F.row_number().over(key.orderBy(F.desc("modified"), "path")).alias("place"))


def read_wind_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, all of ``columns`` as doubles by name; what can't be read is NaN."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.coalesce(F.trim(c).try_cast("double"), F.lit(float("nan"))).alias(c) for c in columns])


def known(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which all of ``columns`` are finite."""
    for c in columns:
        df = df.filter(finite(F.col(c)).isNotNull())
    return df
