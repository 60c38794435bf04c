"""Operators that look at neighbouring samples: windows over lines or pixels, no self join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def along() -> WindowSpec:
    return Window.partitionBy("line").orderBy("pixel")


#: Lines of a block; a column of an image is handled in blocks, each with the lines about it that a stencil reaches.
LINES = 4096


def with_halo(raster: DataFrame, before: int, after: int, lines: int = LINES) -> tuple[DataFrame, WindowSpec, Column]:
    """The raster with a block number for down-column stencils: lines next to a block are in it too.

    Returns the table, the window down a block's column, and whether a row is the block's own.
    """
    block = F.explode(F.sequence(F.floor((F.col("line") - after) / lines), F.floor((F.col("line") + before) / lines)))
    return raster.withColumn("block", block), Window.partitionBy("block", "pixel").orderBy("line"), F.floor(F.col("line") / lines) == F.col("block")


def convolve(raster: DataFrame, kernel: list[float], over: WindowSpec) -> DataFrame:
    """One pass of a separable filter, normalised by the weights of the samples there; weightless sums give 0."""
    half = len(kernel) // 2
    total, weight = F.lit(0.0), F.lit(0.0)
    for i, k in enumerate(kernel):
        x = F.col("value") if i == half else F.lag("value", half - i).over(over)
        total, weight = total + F.coalesce(x * k, F.lit(0.0)), weight + F.when(x.isNotNull(), F.lit(float(k))).otherwise(0.0)
    return raster.withColumn("value", F.when(weight == 0, F.lit(0.0)).otherwise(F.try_divide(total, weight)))


def filter2d(raster: DataFrame, rows: list[float], columns: list[float]) -> DataFrame:
    half = len(rows) // 2
    x, over, own = with_halo(convolve(raster, columns, along()), half, half)
    return convolve(x, rows, over).where(own).drop("block")


def gradient(image: DataFrame) -> DataFrame:
    """Wrapped phase step to the next pixel and to the next line."""
    step = lambda w: F.atan2(F.sin(F.lead("phase").over(w) - F.col("phase")), F.cos(F.lead("phase").over(w) - F.col("phase")))
    x, over, own = with_halo(image.withColumn("across", step(along())), 0, 1)
    return x.select("line", "pixel", "across", step(over).alias("along"), own.alias("own")).where("own").drop("own")


def residues(image: DataFrame) -> DataFrame:
    """The sum of whole turns around each loop of 2 x 2 phases: -1, 0 or 1."""
    turn: Column = F.lit(0.0)
    x, over, own = with_halo(image.withColumn("b", F.lead("phase").over(along())), 0, 1)
    corner = x.withColumns({"d": F.lead("phase").over(over), "c": F.lead("b").over(over)}).where(own)
    corner = corner.withColumnRenamed("phase", "a").where("c is not null and d is not null")
    for p, q in (("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")):
        turn = turn + F.round((F.col(p) - F.col(q)) / (2 * math.pi))
    return corner.select("line", "pixel", turn.cast("int").alias("residue"))


def summed_area(raster: DataFrame) -> DataFrame:
    """Sums over all samples up and left of each: running sums along lines, then down each block, on top of the blocks above."""
    to = lambda w, end=0: w.rowsBetween(Window.unboundedPreceding, end)
    x = raster.withColumn("value", F.sum("value").over(to(along()))).withColumn("block", F.floor(F.col("line") / LINES))
    above = x.groupBy("pixel", "block").agg(F.sum("value").alias("total"))
    above = above.select("pixel", "block", F.coalesce(F.sum("total").over(to(Window.partitionBy("pixel").orderBy("block"), -1)), F.lit(0.0)).alias("above"))
    x = x.withColumn("value", F.sum("value").over(to(Window.partitionBy("pixel", "block").orderBy("line"))))
    return x.join(above, ["pixel", "block"]).select("line", "pixel", (F.col("value") + F.col("above")).alias("value"))


def moving(raster: DataFrame, half: int) -> DataFrame:
    w = along().rowsBetween(-half, half)
    return raster.select("line", "pixel", F.avg("value").over(w).alias("mean"), F.stddev_pop("value").over(w).alias("deviation"))


def median_along(raster: DataFrame, half: int) -> DataFrame:
    """Median of the samples within ``half`` pixels; windows shrink at a line's ends."""
    near = F.array_sort(F.collect_list("value").over(along().rowsBetween(-half, half)))
    x = raster.select("line", "pixel", near.alias("s"))
    low, high = F.floor((F.size("s") - 1) / 2).cast("int"), F.floor(F.size("s") / 2).cast("int")
    return x.select("line", "pixel", ((F.get("s", low) + F.get("s", high)) / 2).alias("value"))


def changes(series: DataFrame) -> DataFrame:
    """Where a value differs from the one before it in its line."""
    return series.withColumn("before", F.lag("value").over(along())).where(F.col("before") != F.col("value")).select("line", "pixel", "before", "value")


def zero_crossings(raster: DataFrame) -> DataFrame:
    """Sign changes along lines (0 counts as positive) with the linear root between the two pixels."""
    x = raster.withColumn("before", F.lag("value").over(along())).where((F.col("before") < 0) != (F.col("value") < 0))
    return x.select("line", "pixel", (F.col("pixel") - 1 + F.col("before") / (F.col("before") - F.col("value"))).alias("root"))


def layover_shadow(profile: DataFrame) -> DataFrame:
    """Bits per sample of a line of sight (line, pixel in the order of cross, cross, elevation, slant).

    1, shadow: the elevation angle is not over the greatest one before it. 2, layover: in the
    order of slant range, the cross-track place is not over the greatest before it, or not
    under the least after it. The reverse pass is a running minimum in descending order.
    """
    past = lambda *by: Window.partitionBy("line").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    shadow = F.col("elevation") <= F.max("elevation").over(past("pixel"))
    near = F.col("cross") <= F.max("cross").over(past("slant", "pixel"))
    far = F.col("cross") >= F.min("cross").over(past(F.desc("slant"), F.desc("pixel")))
    bit = lambda x, n: F.when(F.coalesce(x, F.lit(False)), n).otherwise(0)
    return profile.select("line", "pixel", (bit(shadow, 1) + bit(near | far, 2)).alias("mask"))


def unwrap_steps(series: DataFrame, period: float) -> DataFrame:
    """Adds the running count of jumps by whole periods along each line."""
    jump = F.coalesce(F.round((F.lag("value").over(along()) - F.col("value")) / period), F.lit(0.0))
    steps = series.withColumn("jump", jump)
    return steps.select("line", "pixel", (F.col("value") + period * F.sum("jump").over(along().rowsBetween(Window.unboundedPreceding, 0))).alias("value"))
