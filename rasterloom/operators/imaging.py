"""Spatial joins, image formation and filters with halos; kernels on whole lines or blocks where columns can't say it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from .stencils import along, with_halo


def sigma_weighted(raster: DataFrame, half: int) -> DataFrame:
    """Mean of value along a line weighted by 1 / sigma**2, and its own sigma; samples without either are left out."""
    w = along().rowsBetween(-half, half)
    q = F.when(F.col("value").isNotNull() & (F.col("sigma") > 0), 1 / (F.col("sigma") * F.col("sigma")))
    total = F.sum(q).over(w)
    return raster.select("line", "pixel", F.try_divide(F.sum(q * F.col("value")).over(w), total).alias("value"), F.try_divide(F.lit(1.0), F.sqrt(total)).alias("sigma"))


def local_mean_fill(raster: DataFrame, half: int) -> DataFrame:
    """NaN and null samples become the mean of the valid ones in the square around them, clipped at the edges."""
    v = F.when(~F.isnan("value"), F.col("value"))
    a = along().rowsBetween(-half, half)
    x, over, own = with_halo(raster.withColumns({"s": F.sum(v).over(a), "n": F.count(v).over(a), "v": v}), half, half)
    d = over.rowsBetween(-half, half)
    x = x.withColumns({"s": F.sum("s").over(d), "n": F.sum("n").over(d)}).where(own)
    return x.select("line", "pixel", F.coalesce("v", F.try_divide("s", "n")).alias("value"))


def narrowband_hits(power: DataFrame, half: int, cut: float) -> DataFrame:
    """Samples per pixel whose moving mean over lines lies more than ``cut`` deviations above that pixel's."""
    x, over, own = with_halo(power, half, half)
    x = x.withColumn("m", F.avg("value").over(over.rowsBetween(-half, half))).where(own)
    stats = x.groupBy("pixel").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("dev"))
    z = F.try_divide(F.col("m") - F.col("mean"), F.col("dev"))
    return x.join(stats, "pixel").groupBy("pixel").agg(F.count_if(z > cut).alias("hits"), F.max(z).alias("highest"))


def wideband_hits(power: DataFrame, half: int, cut: float) -> DataFrame:
    """Samples per line whose moving mean over pixels, in dB and without its linear trend, stands out by ``cut`` deviations."""
    x = power.withColumn("m", F.avg("value").over(along().rowsBetween(-half, half))).withColumn("m", 10 * F.log10("m"))
    p = F.col("pixel").cast("double")
    fit = x.groupBy("line").agg(F.regr_slope("m", p).alias("slope"), F.regr_intercept("m", p).alias("base"))
    x = x.join(fit, "line").withColumn("rest", F.col("m") - F.col("base") - F.col("slope") * p)
    stats = x.groupBy("line").agg(F.stddev_pop("rest").alias("dev"))
    return x.join(stats, "line").groupBy("line").agg(F.count_if(F.try_divide("rest", "dev") > cut).alias("hits"))


def area_geocode(cells: DataFrame) -> DataFrame:
    """Area-projection: rectangles (y0, y1, x0, x1, value) spread over the unit cells they overlap; the weighted mean per cell."""
    y = cells.withColumn("line", F.explode(F.sequence(F.floor("y0"), F.ceil("y1") - 1)))
    x = y.withColumn("pixel", F.explode(F.sequence(F.floor("x0"), F.ceil("x1") - 1)))
    high = F.least(F.col("line") + 1, F.col("y1")) - F.greatest(F.col("line"), F.col("y0"))
    wide = F.least(F.col("pixel") + 1, F.col("x1")) - F.greatest(F.col("pixel"), F.col("x0"))
    x = x.withColumn("w", high * wide)
    return x.groupBy("line", "pixel").agg(F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("value"), F.sum("w").alias("looks"))


def scatter(facets: DataFrame) -> DataFrame:
    """Distributes each facet's area at (y, x) over its four neighbours by bilinear weights; sums per pixel."""
    x = facets.withColumns({"y0": F.floor("y"), "x0": F.floor("x")}).withColumns({"fy": F.col("y") - F.floor("y"), "fx": F.col("x") - F.floor("x")})
    parts = [F.struct((F.col("y0") + i).alias("line"), (F.col("x0") + j).alias("pixel"), ((F.col("fy") if i else 1 - F.col("fy")) * (F.col("fx") if j else 1 - F.col("fx")) * F.col("area")).alias("area")) for i in (0, 1) for j in (0, 1)]
    return x.select(F.explode(F.array(*parts)).alias("p")).select("p.*").groupBy("line", "pixel").agg(F.sum("area").alias("area"))


def back_projection(pulses: DataFrame, targets: DataFrame, aperture: int, wavelength: float, spacing: float) -> DataFrame:
    """Focuses targets (target, at, near): sums the pulses (line, pixel, re, im) within ``aperture`` lines of ``at``, each at the
    target's range and turned back by its phase.

    Lines are dealt into bins as wide as the aperture, so that the range join is an equi-join on two or three bins.
    """
    wide = 2 * aperture + 1
    t = targets.withColumn("bin", F.explode(F.sequence(F.floor((F.col("at") - aperture) / wide), F.floor((F.col("at") + aperture) / wide))))
    lines = pulses.withColumn("bin", F.floor(F.col("line") / wide))
    x = t.join(lines, "bin").where(F.abs(F.col("line") - F.col("at")) <= aperture)
    step = F.col("line") - F.col("at")
    x = x.withColumn("place", F.col("near") + step * step / (2.0 * wide)).where(F.floor("place") == F.col("pixel"))
    angle = 4 * math.pi * spacing / wavelength * F.col("place")
    re, im = F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle), F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)
    return x.groupBy("target").agg(F.sum(re).alias("re"), F.sum(im).alias("im"), F.count("*").alias("pulses"))


def nearest(probes: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """Per probe the value of its nearest node in time; the earlier one if both are as near."""
    from .joins import bracket

    x = bracket(probes, nodes, by)
    late = F.col("t0").isNull() | (F.col("t1") - F.col("t") < F.col("t") - F.col("t0"))
    return x.select(by, "probe", F.when(late, F.col("v1")).otherwise(F.col("v0")).alias("value"))


def eigen_interference(image: DataFrame, lines: int, cut: float) -> DataFrame:
    """Slow-time interference: eigenvalues of each block's covariance over ``lines`` pulses, and the power without those above ``cut`` times the median.

    A block is ``lines`` lines by all their pixels: its size is fixed by the sensor, not by the corpus.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = pdf.assign(z=pdf["re"] + 1j * pdf["im"]).pivot_table(index="line", columns="pixel", values="z", aggfunc="sum", fill_value=0).to_numpy()
        values, vectors = np.linalg.eigh(z @ z.conj().T / z.shape[1])
        bad = values > cut * max(np.median(values), 1e-300)
        clean = z - vectors[:, bad] @ (vectors[:, bad].conj().T @ z)
        return pd.DataFrame({"block": [key[0]], "largest": [float(values[-1])], "removed": [int(bad.sum())], "power": [float((np.abs(clean) ** 2).mean())]})

    blocks = image.withColumn("block", F.floor(F.col("line") / lines))
    return blocks.groupBy("block").applyInPandas(run, "block long, largest double, removed long, power double")


def radar_coordinates(targets: DataFrame, radius: float = 7.1e6, rate: float = 1.05e-3) -> DataFrame:
    """Zero-Doppler time and slant range of targets (id, x, y, z) seen from a circular orbit; nan where none is found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xyz = pdf[["x", "y", "z"]].to_numpy(float)
            t, slant = geometry.geo2rdr(xyz, radius, rate)
            yield pd.DataFrame({"id": pdf["id"], "time": t, "slant": slant})

    return targets.mapInPandas(run, "id long, time double, slant double")


def line_regions(raster: DataFrame) -> DataFrame:
    """Connected runs of equal value along each line: one label per run, its first pixel, and its size."""
    new = F.coalesce(F.lag("value").over(along()) != F.col("value"), F.lit(True))
    x = raster.withColumn("label", F.last(F.when(new, F.col("pixel")), ignorenulls=True).over(along()))
    return x.withColumn("size", F.count("*").over(Window.partitionBy("line", "label")))
