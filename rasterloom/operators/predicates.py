"""Filters, masks and arithmetic on samples, grids and tables of state vectors: one expression each, all in columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

NAN = float("nan")


def baseband(image: DataFrame, carrier: DataFrame, prf: float, up: bool = False) -> DataFrame:
    """Takes the Doppler carrier (pixel, doppler in Hz) off every line at line / prf seconds; ``up`` puts it back."""
    angle = (2 if up else -2) * math.pi * F.col("doppler") * F.col("line") / prf
    re, im = S.rotated(F.col("re"), F.col("im"), angle)
    return image.join(carrier, "pixel").select("line", "pixel", re.alias("re"), im.alias("im"))


def at_least_decibel(x: Column, decibel: float) -> Column:
    """x, or NaN where it is below the power ratio of so many decibels."""
    return F.when(x >= 10.0 ** (decibel / 10), x).otherwise(F.lit(NAN))


def is_data(x: Column, nodata: float) -> Column:
    """Whether a sample is not the no-data value, which may be NaN."""
    return ~F.isnan(x) if math.isnan(nodata) else F.isnan(x) | (x != nodata)


def clamp(x: Column, low: float, high: float) -> Column:
    """x between two bounds; NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def truncated(x: Column, bits: int) -> Column:
    """x with only its first ``bits`` bits after the leading one, cut towards zero; zero and what is not finite stay."""
    m = F.abs(x)
    rough = F.floor(F.log2(m))
    power = F.pow(F.lit(2.0), rough)
    exponent = F.when(power > m, rough - 1).when(power * 2 <= m, rough + 1).otherwise(rough)
    unit = F.pow(F.lit(2.0), exponent - bits)
    usual = (m > 0) & ~F.isnan(x) & (m < float("inf"))
    return F.when(usual, F.signum(x) * F.floor(m / unit) * unit).otherwise(x)


def crop(vectors: DataFrame, start: float, end: float, pad: int = 0, by: str = "sat") -> DataFrame:
    """The state vectors (by, t) that bracket [start, end], with ``pad`` more at either end, per key; none if a key does not reach over it."""
    w = Window.partitionBy(by)
    x = vectors.withColumns({"i": F.row_number().over(w.orderBy("t")), "lo": F.min("t").over(w), "hi": F.max("t").over(w)})
    first = F.max(F.when(F.col("t") < start, F.col("i"))).over(w)
    last = F.min(F.when(F.col("t") > end, F.col("i"))).over(w)
    x = x.withColumns({"a": F.coalesce(first, F.lit(1)), "b": F.coalesce(last, F.max("i").over(w))})
    kept = (F.col("lo") <= start) & (F.col("hi") >= end) & (F.col("i") >= F.col("a") - pad) & (F.col("i") <= F.col("b") + pad)
    return x.where(kept).select(*vectors.columns)


#: A grid is a row (start, spacing, n) for either axis; these take and give such columns.
def sliced(start: Column, spacing: Column, first: Column, stop: Column) -> tuple[Column, Column, Column]:
    return start + first * spacing, spacing, F.greatest(stop - first, F.lit(0))


def looked_down(start: Column, spacing: Column, n: Column, looks: int) -> tuple[Column, Column, Column]:
    """The grid of whole windows of ``looks`` samples, placed at their middles."""
    return start + (looks - 1) * 0.5 * spacing, spacing * looks, F.floor(n / looks)


def upsampled(start: Column, spacing: Column, n: Column, factor: int) -> tuple[Column, Column, Column]:
    return start, spacing / factor, n * factor


def offset(start: Column, spacing: Column, n: Column, by: Column, more: Column) -> tuple[Column, Column, Column]:
    """The grid moved by so many samples and resized by so many."""
    return start + by * spacing, spacing, F.greatest(n + more, F.lit(0))


def valid_grid(wavelength: Column, prf: Column, spacing: Column, lines: Column, pixels: Column, start: Column) -> Column:
    """Whether a radar grid has positive spacings and sizes."""
    return (wavelength > 0) & (prf > 0) & (spacing > 0) & (lines > 0) & (pixels > 0) & (start > 0)


def fill_gaps(image: DataFrame, swaths: DataFrame, re: float = 0.0, im: float = 0.0) -> DataFrame:
    """A fixed value outside the valid [start, stop) of each line; swaths with stop <= start are none."""
    spans = swaths.where("stop > start").groupBy("line").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    x = image.join(spans, "line", "left")
    inside = F.coalesce(F.exists("spans", lambda s: (F.col("pixel") >= s["start"]) & (F.col("pixel") < s["stop"])), F.lit(False))
    return x.select("line", "pixel", F.when(inside, F.col("re")).otherwise(re).alias("re"), F.when(inside, F.col("im")).otherwise(im).alias("im"))


def outside(x: Column, low: float, high: float) -> Column:
    """Whether a range is not one that the baseline is known for."""
    return F.isnan(x) | (x < low) | (x > high)


def along_track_metres(pixels: Column, velocity: Column, interval: float) -> Column:
    return pixels * velocity * interval


def slant_metres(pixels: Column, spacing: float) -> Column:
    return pixels * spacing


#: Uses that a corner reflector is good for, as bits.
IMPULSE_RESPONSE, RADIOMETRY, GEOMETRY = 1, 2, 4


def usable(validity: Column, flags: int | None = None) -> Column:
    """Whether a reflector is good for any of the uses, or for any use at all."""
    return (validity if flags is None else validity.bitwiseAND(F.lit(flags))) != 0


def heads_to(azimuth: Column, heading: float, tolerance: float = math.radians(20.0)) -> Column:
    return F.abs(S.wrapped(azimuth - heading)) <= tolerance


def calibrated(start: Column, end: Column, after: Column, before: Column) -> Column:
    """Whether an observation lies within a calibration's validity; an open end is null. An end before its start is an error."""
    fits = (start >= after) & F.coalesce(end <= before, F.lit(True))
    return F.when(end < start, F.raise_error(F.lit("an observation ends before it starts")).cast("boolean")).otherwise(fits)


def noise_only(lines: DataFrame, kind: str = "noise") -> DataFrame:
    """The lines recorded without an echo, told by their calibration path."""
    return lines.where(F.col("path") == kind)


def near_polygon(x: Column, y: Column, corners: list[tuple[float, float]], buffer: float) -> Column:
    """Whether a point lies in a polygon or within ``buffer`` of its edges."""
    from ..functions.geometry import inside

    close = F.lit(False)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        dx, dy = x2 - x1, y2 - y1
        length = dx * dx + dy * dy
        share = F.least(F.greatest(((x - x1) * dx + (y - y1) * dy) / length, F.lit(0.0)), F.lit(1.0)) if length else F.lit(0.0)
        u, v = x - x1 - share * dx, y - y1 - share * dy
        close = close | (u * u + v * v <= buffer * buffer)
    return inside(x, y, corners) | close


def relocated(targets: DataFrame, grid: DataFrame, north: Column, east: Column, shape: tuple[int, int], origin: tuple[float, float], spacing: tuple[float, float]) -> DataFrame:
    """A map raster (iy, ix, v) looked up at other maps' places (probe, and their coordinates in this raster's projection)."""
    from .joins import lut2d

    at = targets.select("probe", ((north - origin[0]) / spacing[0]).alias("y"), ((east - origin[1]) / spacing[1]).alias("x"))
    return lut2d(at, grid, *shape)
