"""Readers. Every schema is explicit; directories and globs are read in one scan."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustframe.functions.nulls import nan_to_null, sentinels_to_null
from gustframe.functions.text import decimal_comma, found, part, station_id


def delimited(spark: SparkSession, path: str | list[str], schema: T.StructType, sep: str = ",", encoding: str = "UTF-8", comma_decimals: bool = False, with_path: bool = False) -> DataFrame:
    """CSV with a header. comma_decimals: numbers may be written with a comma or a point, text in their place is null."""
    given = schema
    if comma_decimals:
        given = T.StructType([T.StructField(f.name, T.StringType()) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else f for f in schema])
    df = spark.read.schema(given).csv(path, sep=sep, header=True, encoding=encoding, enforceSchema=True)
    if comma_decimals:
        df = df.withColumns({f.name: decimal_comma(f.name) for f in schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})
    if with_path:
        df = df.withColumn("path", F.col("_metadata.file_path"))
    return nan_to_null(df)


def station_series(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """All files Station_<id>.csv below path; the id comes from the file's name."""
    own = T.StructType([f for f in schema])
    df = delimited(spark, path, own, sep, with_path=True)
    return df.withColumn("station_id", station_id(found("path", r"_(\d+)\.[A-Za-z]+$"))).drop("path")


def measurements(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Raw ten-minute files: ';', blanks in names, stamps yyyyMMddHHmm in UTC, -999 for missing.

    columns: the file's columns in order, as the schema; quality flags and the end mark go."""
    schema = T.StructType([T.StructField(c.strip(), T.StringType() if c.strip() in ("STATIONS_ID", "MESS_DATUM", "eor") else T.DoubleType()) for c in columns])
    return measured(spark.read.schema(schema).csv(path, sep=";", header=True, enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True))


def measured(raw: DataFrame) -> DataFrame:
    """(station_id, timestamp, values) of raw rows: stamps parsed, -999 and -9999 null, quality flags and the end mark gone."""
    schema = raw.schema
    values = [f.name for f in schema if isinstance(f.dataType, T.DoubleType) and f.name not in ("QN", "RWS_IND_10")]
    df = raw.select(station_id("STATIONS_ID").alias("station_id"), F.try_to_timestamp("MESS_DATUM", F.lit("yyyyMMddHHmm")).alias("timestamp"), *values)
    return sentinels_to_null(df, values)


#: First character and length of each field of a registry line.
REGISTRY_FIELDS = {"id": (1, 5), "von": (7, 8), "bis": (16, 8), "height": (25, 14), "latitude": (39, 12), "longitude": (51, 10), "name": (62, 41), "state": (103, 40)}


def registry(spark: SparkSession, path: str, fields: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Fixed-width registries in Latin-1 with two header lines; the variable is the name of the file's folder."""
    # A separator that doesn't occur makes each line one column, in the file's encoding.
    lines = spark.read.schema("line string").csv(path, sep="\u0001", encoding="ISO-8859-1", quote="", ignoreLeadingWhiteSpace=False)
    return registry_lines(lines.withColumn("path", F.col("_metadata.file_path")), fields)


def registry_lines(lines: DataFrame, fields: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """The same from lines (line, path); headers and other lines that don't begin with an id and a date go. Dates that
    are blank or no days of a calendar are null: a station without an end is still there."""
    at = fields or REGISTRY_FIELDS

    def cut(name: str):
        start, size = at[name]
        return F.trim(F.substring("line", start, size))

    return lines.filter(F.col("line").rlike(r"^\s*\d+\s+\d{8}")).select(
        station_id(cut("id")).alias("station_id"),
        F.try_to_date(cut("von"), "yyyyMMdd").alias("valid_from"),
        F.try_to_date(cut("bis"), "yyyyMMdd").alias("valid_to"),
        *[cut(c).try_cast("double").alias(c) for c in ("height", "latitude", "longitude")],
        cut("name").alias("name"),
        cut("state").alias("state"),
        part("path", "/", -2).alias("variable"),
    )


def xml_units(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    """Elements as rows; the schema is the list of tags that are read, missing ones are null."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def zip_members(spark: SparkSession, path: str, encoding: str = "latin-1") -> DataFrame:
    """(path, member, line_no, line) of the first member of each zip file. A file is unpacked by one task, line by line."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    member = z.namelist()[0]
                    rows = []
                    with z.open(member) as f:
                        for i, line in enumerate(io.TextIOWrapper(f, encoding)):
                            rows.append((name, member, i, line.rstrip("\r\n")))
                            if len(rows) >= 50_000:
                                yield pd.DataFrame(rows, columns=["path", "member", "line_no", "line"])
                                rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=["path", "member", "line_no", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, line_no long, line string")


def curves(spark: SparkSession, path: str, turbines: list[str], kilowatts: bool = True) -> DataFrame:
    """A wide catalogue, one column a turbine, as long rows (turbine, ws_c, power_w); decimal commas or points."""
    schema = T.StructType([T.StructField("wind_speed", T.DoubleType())] + [T.StructField(t, T.DoubleType()) for t in turbines])
    wide = delimited(spark, path, schema, sep=";", comma_decimals=True)
    long = wide.unpivot(["wind_speed"], turbines, "turbine", "power").filter("power is not null and wind_speed is not null")
    ws = F.rint(F.col("wind_speed") * 100).cast("int")
    return long.select("turbine", ws.alias("ws_c"), (F.col("power") * (1000 if kilowatts else 1)).alias("power_w")).dropDuplicates(["turbine", "ws_c"])


def ages(spark: SparkSession, path: str) -> DataFrame:
    """(idx, age) of a saved array of ages; a few thousand numbers, read here."""
    import numpy as np

    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(np.load(path, allow_pickle=False))], "idx long, age double")


def table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A database table in one parallel scan; filters and column lists on the result are pushed down. Secrets come in options."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def missing_files(wanted: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    """Names that aren't there yet."""
    return wanted.join(present.select(name), name, "left_anti")


def html_objects(df: DataFrame, html: str, marker: str) -> DataFrame:
    """df with `body`: the balanced {...} that follows a marker in a page's script; null without one."""

    @F.pandas_udf("string")
    def balanced(pages: pd.Series) -> pd.Series:
        def cut(page: str | None) -> str | None:
            at = page.find(marker) if page else -1
            at = page.find("{", at) if at >= 0 else -1
            if at < 0:
                return None
            depth, quote = 0, ""
            for i in range(at, len(page)):
                c = page[i]
                if quote:
                    quote = "" if c == quote and page[i - 1] != "\\" else quote
                elif c in "\"'":
                    quote = c
                elif c in "{}":
                    depth += 1 if c == "{" else -1
                    if not depth:
                        return page[at : i + 1]
            return None

        return pages.map(cut)

    return df.withColumn("body", balanced(html))
