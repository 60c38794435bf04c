"""Raster tables: long form (line, pixel, value) or (line, pixel, re, im) from stored line arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shape(lines: DataFrame, line: str = "vec_id", values: str = "embedding", parts: int = 1) -> tuple[int, int]:
    """Lines and pixels of a raster kept as lines of ``parts`` values a pixel, without taking the lines apart."""
    found = lines.agg(F.max(line), F.max(F.size(values))).first()
    return (found[0] if found[0] is not None else -1) + 1, (found[1] or 0) // parts


def real_raster(lines: DataFrame, line: str = "vec_id", values: str = "embedding") -> DataFrame:
    """One row per sample of rows that hold a whole line as an array."""
    out = lines.select(F.col(line).alias("line"), F.posexplode(values).alias("pixel", "value"))
    return out.select("line", F.col("pixel").cast("long").alias("pixel"), F.col("value").cast("double").alias("value"))


def complex_raster(lines: DataFrame, line: str = "vec_id", values: str = "embedding") -> DataFrame:
    """Samples of interleaved real and imaginary parts; an odd last value is left out."""
    n = F.floor(F.size(values) / 2).cast("int")
    pixels = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    out = lines.select(F.col(line).alias("line"), F.explode(pixels).alias("pixel"), F.col(values).alias("v"))
    part = lambda k: F.get("v", F.col("pixel") * 2 + k).cast("double")
    return out.select("line", F.col("pixel").cast("long").alias("pixel"), part(0).alias("re"), part(1).alias("im"))


def line_arrays(raster: DataFrame, value: str = "value") -> DataFrame:
    """The inverse of real_raster: one row (line, values) per line, pixels in order."""
    pairs = F.array_sort(F.collect_list(F.struct("pixel", F.col(value).alias("v"))))
    return raster.groupBy("line").agg(F.transform(pairs, lambda x: x["v"]).alias("values"))


def write_bands(raster: DataFrame, path: str) -> None:
    """Writes a raster table with a column ``band`` so that a band's samples can be read alone."""
    raster.write.partitionBy("band").parquet(path)


def corner_reflectors(spark: SparkSession, path: str) -> DataFrame:
    """Surveyed reflectors from CSV of seven or twelve columns; angles to radians, blanks trimmed, comments skipped."""
    names = "id lat lon height azimuth elevation side survey validity ve vn vu".split()
    raw = spark.read.schema(", ".join(f"{x} string" for x in names)).csv(path, header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    number = lambda x: F.col(x).try_cast("double")
    return raw.select(
        "id", F.radians(number("lat")).alias("latitude"), F.radians(number("lon")).alias("longitude"), number("height").alias("height"),
        F.radians(number("azimuth")).alias("azimuth"), F.radians(number("elevation")).alias("elevation"), number("side").alias("side_length"),
        F.to_timestamp_ntz("survey").alias("survey_date"), F.col("validity").try_cast("int").alias("validity"),
        *(F.coalesce(number(x), F.lit(0.0)).alias(y) for x, y in (("ve", "velocity_east"), ("vn", "velocity_north"), ("vu", "velocity_up"))),
    )
