"""Multilooking, statistics and estimators: all mergeable, so partial sums go before any shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .stencils import with_halo


Shape = tuple[int, int] | None


def _window(raster: DataFrame, lines: int, pixels: int, shape: Shape = None) -> GroupedData:
    """Groups whole windows only: partial ones at the far edges are dropped. shape (lines, pixels) spares a pass over the raster."""
    if shape is None:
        found = raster.agg(F.max("line"), F.max("pixel")).first()
        shape = (found[0] or 0) + 1, (found[1] or 0) + 1
    inside = (F.col("line") < shape[0] // lines * lines) & (F.col("pixel") < shape[1] // pixels * pixels)
    return raster.where(inside).withColumns({"line": F.floor(F.col("line") / lines), "pixel": F.floor(F.col("pixel") / pixels)}).groupBy("line", "pixel")


def multilook(raster: DataFrame, lines: int, pixels: int, shape: Shape = None) -> DataFrame:
    return _window(raster, lines, pixels, shape).agg(F.sum("value").alias("total"), F.avg("value").alias("mean"))


def multilook_weighted(raster: DataFrame, lines: int, pixels: int, shape: Shape = None) -> DataFrame:
    """Sum(w x) / sum(w); a window of no weight is NaN."""
    total = F.sum("weight")
    out = F.when(total == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.sum(F.col("weight") * F.col("value")), total))
    return _window(raster, lines, pixels, shape).agg(out.alias("mean"), total.alias("weight"))


def multilook_power(image: DataFrame, lines: int, pixels: int, shape: Shape = None) -> DataFrame:
    return _window(image, lines, pixels, shape).agg(F.avg(S.power(F.col("re"), F.col("im"))).alias("power"))


def multilook_interferogram(both: DataFrame, lines: int, pixels: int, shape: Shape = None) -> DataFrame:
    """Looked-down interferogram of co-registered samples (re, im, re2, im2), its phase and coherence, in one pass."""
    re, im = S.times_conjugate(F.col("re"), F.col("im"), F.col("re2"), F.col("im2"))
    p1, p2 = S.power(F.col("re"), F.col("im")), S.power(F.col("re2"), F.col("im2"))
    out = _window(both, lines, pixels, shape).agg(
        F.avg(re).alias("re"), F.avg(im).alias("im"), F.avg(p1).alias("p1"), F.avg(p2).alias("p2")
    )
    coherence = F.try_divide(F.hypot("re", "im"), F.sqrt(F.col("p1") * F.col("p2")))
    return out.select("line", "pixel", "re", "im", F.atan2("im", "re").alias("phase"), coherence.alias("coherence"))


def real_stats(raster: DataFrame) -> DataFrame:
    """Count, extrema, mean and sample deviation of the samples that are not NaN; deviation 0 for one sample."""
    x = F.nanvl("value", F.lit(None).cast("double"))
    dev = F.when(F.count(x) <= 1, F.lit(0.0)).otherwise(F.stddev_samp(x))
    return raster.agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), dev.alias("deviation"))


def complex_stats(image: DataFrame) -> DataFrame:
    """Extrema by modulus but complex, complex mean, deviation of the modulus; a sample with a NaN part is skipped."""
    good = image.where(~(F.isnan("re") | F.isnan("im"))).withColumn("m", F.hypot("re", "im"))
    value, order = F.struct("re", "im"), F.struct("m", "line", "pixel")
    out = good.agg(
        F.count("*").alias("n"), F.min_by(value, order).alias("low"), F.max_by(value, order).alias("high"), F.avg("re").alias("mean_re"),
        F.avg("im").alias("mean_im"), F.when(F.count("*") <= 1, F.lit(0.0)).otherwise(F.stddev_samp("m")).alias("deviation"),
    )
    return out.select("n", F.col("low.re").alias("low_re"), F.col("low.im").alias("low_im"), F.col("high.re").alias("high_re"), F.col("high.im").alias("high_im"), "mean_re", "mean_im", "deviation")


def mask_percentages(mask: DataFrame) -> DataFrame:
    """Shares of layover (2), shadow (1) and water (4) among values 0..7, in per cent."""
    valid = F.count_if(F.col("mask").between(0, 7))

    def share(bit: int) -> Column:
        hit = F.col("mask").between(0, 7) & (F.col("mask").bitwiseAND(F.lit(bit)) != 0)
        return F.round(F.try_divide(F.count_if(hit) * 100.0, valid), 2)

    return mask.agg(share(1).alias("shadow"), share(2).alias("layover"), share(4).alias("water"))


def doppler_by_correlation(image: DataFrame, prf: float, lag: int = 1) -> DataFrame:
    """Doppler centroid per pixel column from the mean of z[n + lag] conj(z[n]), with its correlation."""
    x, w, own = with_halo(image, lag, 0)
    before = x.withColumns({"re2": F.lag("re", lag).over(w), "im2": F.lag("im", lag).over(w)}).where(own & F.col("re2").isNotNull())
    re, im = S.times_conjugate(F.col("re"), F.col("im"), F.col("re2"), F.col("im2"))
    p = F.sqrt(F.avg(S.power(F.col("re"), F.col("im"))) * F.avg(S.power(F.col("re2"), F.col("im2"))))
    out = before.groupBy("pixel").agg(F.avg(re).alias("x"), F.avg(im).alias("y"), p.alias("p"))
    return out.select("pixel", (prf / (2 * math.pi * lag) * F.atan2("y", "x")).alias("doppler"), F.try_divide(F.hypot("x", "y"), F.col("p")).alias("correlation"))


def noise_power(image: DataFrame, block: int) -> DataFrame:
    """Per block of pixels: mean power of differences of neighbouring lines, halved."""
    x, w, own = with_halo(image, 1, 0)
    gap = x.withColumns({"dr": F.col("re") - F.lag("re").over(w), "di": F.col("im") - F.lag("im").over(w)}).where(own & F.col("dr").isNotNull())
    return gap.groupBy(F.floor(F.col("pixel") / block).alias("block")).agg((F.avg(S.power(F.col("dr"), F.col("di"))) / 2).alias("noise"))


def trimmed(values: DataFrame, fraction: float, bins: int = 1024) -> DataFrame:
    """Mean and population deviation per group after cutting half the fraction at either end.

    Counts in even bins tell in which bin either cut falls; only the rows of those two are
    put in order, all others count or don't by their bin.
    """
    ends = values.groupBy("group").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    binned = values.join(ends, "group")
    bin_ = F.coalesce(F.least(F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1)), F.lit(0))
    binned = binned.select("group", "value", "n", bin_.alias("bin"))
    upto = Window.partitionBy("group").orderBy("bin")
    counts = binned.groupBy("group", "bin").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = binned.join(counts, ["group", "bin"])
    cut = F.rint(F.col("n") * (0.5 * fraction))
    whole = (F.col("before") >= cut) & (F.col("before") + F.col("k") <= F.col("n") - cut)
    none = (F.col("before") + F.col("k") <= cut) | (F.col("before") >= F.col("n") - cut)
    i = F.col("before") + F.row_number().over(Window.partitionBy("group", "bin").orderBy("value"))
    edge = x.where(~whole & ~none).withColumn("i", i).where((F.col("i") > cut) & (F.col("i") <= F.col("n") - cut))
    kept = x.where(whole).select("group", "value").unionByName(edge.select("group", "value"))
    return kept.groupBy("group").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))


def faraday_rotation(hh_hv: DataFrame, lines: int) -> DataFrame:
    """Rotation per block of lines from circular terms: a quarter of the phase of mean(LR conj(RL))."""
    a = {k: F.col(k) for k in ("hh_re", "hh_im", "hv_re", "hv_im", "vh_re", "vh_im", "vv_re", "vv_im")}
    lr = a["vh_re"] - a["hv_re"] - a["hh_im"] - a["vv_im"], a["vh_im"] - a["hv_im"] + a["hh_re"] + a["vv_re"]
    rl = a["hv_re"] - a["vh_re"] - a["hh_im"] - a["vv_im"], a["hv_im"] - a["vh_im"] + a["hh_re"] + a["vv_re"]
    re, im = S.times_conjugate(*lr, *rl)
    out = hh_hv.groupBy(F.floor(F.col("line") / lines).alias("block")).agg(F.avg(re).alias("x"), F.avg(im).alias("y"))
    return out.select("block", (0.25 * F.atan2("y", "x")).alias("rotation"))


def covariance(bands: DataFrame, names: list[str], lines: int) -> DataFrame:
    """Mean of z_i conj(z_j) for i <= j per block of lines; bands has columns <name>_re, <name>_im."""
    terms = []
    for i, p in enumerate(names):
        for q in names[i:]:
            re, im = S.times_conjugate(*(F.col(f"{x}_{y}") for x in (p, q) for y in ("re", "im")))
            terms += [F.avg(re).alias(f"{p}{q}_re"), F.avg(im).alias(f"{p}{q}_im")]
    return bands.groupBy(F.floor(F.col("line") / lines).alias("block")).agg(*terms)


def line_fit(points: DataFrame) -> DataFrame:
    """Least-squares line per group."""
    return points.groupBy("group").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def peak(raster: DataFrame) -> DataFrame:
    """The largest sample; the first in raster order among equals."""
    best = F.max_by(F.struct("line", "pixel", "value"), F.struct("value", -F.col("line"), -F.col("pixel")))
    return raster.where(~F.isnan("value")).agg(best.alias("b")).select("b.*")


def latest_before(rows: DataFrame, key: str, when: str, limit: str) -> DataFrame:
    """The latest row of each key at or before a moment: one partial maximum per key, no sort."""
    past = rows.where(F.col(when) <= F.lit(limit).cast("timestamp_ntz"))
    rest = [c for c in rows.columns if c != key]
    return past.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(when, *(c for c in rest if c != when))).alias("r")).select(key, "r.*")
