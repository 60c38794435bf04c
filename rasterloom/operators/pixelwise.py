"""Operators on single samples and on co-registered rasters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

KEY = ["line", "pixel"]


def pair(reference: DataFrame, secondary: DataFrame) -> DataFrame:
    """Co-registered samples: re, im of the reference and re2, im2 of the secondary image."""
    return reference.join(secondary.withColumnsRenamed({"re": "re2", "im": "im2"}), KEY)


def pair_lines(reference: DataFrame, secondary: DataFrame) -> DataFrame:
    """Co-registered samples of images kept as lines (line, values: real and imaginary parts in turn): lines meet, one row each, before they are taken apart."""
    both = reference.join(secondary.withColumnRenamed("values", "values2"), "line")
    n = F.floor(F.least(F.size("values"), F.size("values2")) / 2).cast("int")
    x = both.select("line", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("pixel"), "values", "values2")
    part = lambda c, k: F.get(c, F.col("pixel") * 2 + k).cast("double")
    return x.select("line", F.col("pixel").cast("long").alias("pixel"), part("values", 0).alias("re"), part("values", 1).alias("im"), part("values2", 0).alias("re2"), part("values2", 1).alias("im2"))


def interferogram(reference: DataFrame, secondary: DataFrame) -> DataFrame:
    re, im = S.times_conjugate(F.col("re"), F.col("im"), F.col("re2"), F.col("im2"))
    return pair(reference, secondary).select(*KEY, re.alias("re"), im.alias("im"))


def flatten(image: DataFrame, offsets: DataFrame, spacing: float, wavelength: float, start_shift: float = 0.0) -> DataFrame:
    """Removes exp(j 4 pi dr (offset + shift / dr) / wavelength)."""
    angle = -4 * math.pi * spacing / wavelength * (F.col("offset") + start_shift / spacing)
    re, im = S.rotated(F.col("re"), F.col("im"), angle)
    return image.join(offsets, KEY).select(*KEY, re.alias("re"), im.alias("im"))


def symmetrise(hv: DataFrame, vh: DataFrame) -> DataFrame:
    return pair(hv, vh).select(*KEY, ((F.col("re") + F.col("re2")) * 0.5).alias("re"), ((F.col("im") + F.col("im2")) * 0.5).alias("im"))


def clip_magnitude(image: DataFrame, low: float, high: float) -> DataFrame:
    """Bounds the modulus, keeps the phase; modulus 0 has no phase and gives NaN."""
    m = F.hypot("re", "im")
    to = F.when(m == 0, F.lit(float("nan"))).otherwise(F.least(F.greatest(m, F.lit(low)), F.lit(high)) / m)
    return image.select(*KEY, (F.col("re") * to).alias("re"), (F.col("im") * to).alias("im"))


def decimate(raster: DataFrame, lines: int, pixels: int, line0: int = 0, pixel0: int = 0) -> DataFrame:
    """Every lines-th and pixels-th sample from the offsets on; partial ends are kept."""
    here = (F.col("line") >= line0) & (F.col("pixel") >= pixel0)
    here &= ((F.col("line") - line0) % lines == 0) & ((F.col("pixel") - pixel0) % pixels == 0)
    return raster.where(here).withColumns({"line": F.floor((F.col("line") - line0) / lines), "pixel": F.floor((F.col("pixel") - pixel0) / pixels)})


def sum_valid(a: DataFrame, b: DataFrame, invalid: float) -> DataFrame:
    """a + b where both are there and valid, else the invalid value."""
    both = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), KEY, "full")
    bad = F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == invalid) | (F.col("b") == invalid)
    return both.select(*KEY, F.when(bad, F.lit(invalid)).otherwise(F.col("a") + F.col("b")).alias("value"))


def add_water(mask: DataFrame, water: DataFrame) -> DataFrame:
    """Adds 4 to mask values 0..3 over water; other values are fill and stay."""
    both = mask.join(water, KEY, "left")
    wet = F.coalesce(F.col("water"), F.lit(False)) & F.col("mask").between(0, 3)
    return both.select(*KEY, F.when(wet, F.col("mask") + 4).otherwise(F.col("mask")).alias("mask"))


def decode(samples: DataFrame, table: DataFrame) -> DataFrame:
    """Codes (r, i) to values by a lookup table (code, level) of at most 2**16 codes, or an error; so it can be broadcast."""
    if table.limit((1 << 16) + 1).count() > 1 << 16:
        raise ValueError("a code has 16 bits: the table has too many rows")
    r, i = (F.broadcast(table.select(F.col("code").alias(c), F.col("level").alias(v))) for c, v in (("r", "re"), ("i", "im")))
    return samples.join(r, "r").join(i, "i").select(*KEY, "re", "im")


def dispersive(low: DataFrame, high: DataFrame, f0: float, fl: float, fh: float) -> DataFrame:
    both = low.withColumnRenamed("value", "low").join(high.withColumnRenamed("value", "high"), KEY)
    a, b = S.dispersive_pair(F.col("low"), F.col("high"), f0, fl, fh)
    return both.select(*KEY, a.alias("dispersive"), b.alias("non_dispersive"))
