"""Estimators over blocks: statistics, polarimetry, noise, Doppler, interference, fits; all mergeable sums unless a kernel is named."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.shared import written
from .stencils import along, with_halo


def part_stats(image: DataFrame) -> DataFrame:
    """Statistics of the real and the imaginary parts on their own; a sample with a NaN part is left out of both."""
    good = image.where(~(F.isnan("re") | F.isnan("im")))
    out = []
    for p in ("re", "im"):
        dev = F.when(F.count("*") <= 1, F.lit(0.0)).otherwise(F.stddev_samp(p))
        out += [F.min(p).alias(f"low_{p}"), F.max(p).alias(f"high_{p}"), F.avg(p).alias(f"mean_{p}"), dev.alias(f"deviation_{p}")]
    return good.agg(F.count("*").alias("n"), *out)


def extent(surface: DataFrame, nodata: float | None = None) -> DataFrame:
    """Least, greatest and mean height, without no-data and NaN."""
    h = F.col("value")
    good = ~F.isnan(h) if nodata is None else ~F.isnan(h) & (h != nodata)
    return surface.where(good).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))


def weighted_looks(image: DataFrame, lines: int, pixels: int, shape: tuple[int, int]) -> DataFrame:
    """Sum(w z) / sum(w) of complex samples over whole windows; a window without weight is NaN."""
    from .aggregates import _window

    w = F.sum("weight")
    mean = lambda c: F.when(w == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.sum(F.col("weight") * F.col(c)), w)).alias(c)
    return _window(image, lines, pixels, shape).agg(mean("re"), mean("im"), w.alias("weight"))


def looks_without(raster: DataFrame, lines: int, pixels: int, shape: tuple[int, int], nodata: float) -> DataFrame:
    """Mean of a window's samples that are data; the no-data value where none is."""
    from .aggregates import _window

    x = F.when(F.col("value") != nodata, F.col("value"))
    return _window(raster, lines, pixels, shape).agg(F.coalesce(F.avg(x), F.lit(nodata)).alias("mean"), F.count(x).alias("n"))


def averaged_table(grid: DataFrame, axis: str) -> DataFrame:
    """A two-dimensional table (y, x, v) averaged to one along the other axis."""
    return grid.groupBy(axis).agg(F.avg("v").alias("v"))


def polygon_mean(samples: DataFrame, looks: float = 1.0) -> DataFrame:
    """Per polygon (id) the mean of re, im weighted by the weight's modulus, and the number of looks."""
    w = F.abs(F.col("weight"))
    total = F.sum(w)
    return samples.groupBy("id").agg(F.try_divide(F.sum(w * F.col("re")), total).alias("re"), F.try_divide(F.sum(w * F.col("im")), total).alias("im"), (total * looks).alias("looks"))


def interference_mask(hits: DataFrame, share: float) -> DataFrame:
    """Samples whose narrow-band (nb) or wide-band (wb) hits are over that mask's quantile 1 - share; hits are small counts."""
    cuts = hits.agg(F.percentile("nb", F.lit(1 - share)), F.percentile("wb", F.lit(1 - share))).first()
    return hits.select("line", "pixel", ((F.col("nb") > cuts[0]) | (F.col("wb") > cuts[1])).alias("mask"))


def interference_share(hits: DataFrame) -> DataFrame:
    """How many pulses, of all pulses and range blocks, have any flagged sample."""
    per = hits.groupBy("line", "block").agg(F.max(F.col("flag").cast("int")).alias("any"))
    return per.agg(F.avg("any").alias("likelihood"), F.count("*").alias("n"))


def doppler_by_sign(image: DataFrame, prf: float, lag: int = 1) -> DataFrame:
    """Doppler centroid per block of lines from the correlations of signs, by the arcsine law; 0 counts as positive."""
    sign = lambda c: F.when(F.col(c) < 0, -1.0).otherwise(1.0)
    x, w, own = with_halo(image.withColumns({"i": sign("re"), "q": sign("im")}), lag, 0)
    x = x.withColumns({"i0": F.lag("i", lag).over(w), "q0": F.lag("q", lag).over(w)}).where(own & F.col("i0").isNotNull())
    mean = x.groupBy("pixel").agg(*(F.avg(F.col(a) * F.col(f"{b}0")).alias(f"{a}{b}") for a in "iq" for b in "iq"))
    s = lambda c: F.sin(0.5 * math.pi * F.col(c))
    return mean.select("pixel", (prf / (2 * math.pi * lag) * F.atan2(s("qi") - s("iq"), s("ii") + s("qq"))).alias("doppler"))


def doppler_by_looks(image: DataFrame, prf: float, gap: float) -> DataFrame:
    """Doppler centroid from two range looks (re, im and re2, im2, ``gap`` apart relative to the carrier): the phase of the change of their product from line to line."""
    re, im = S.times_conjugate(F.col("re"), F.col("im"), F.col("re2"), F.col("im2"))
    x, w, own = with_halo(image.withColumns({"a": re, "b": im}), 1, 0)
    x = x.withColumns({"a0": F.lag("a").over(w), "b0": F.lag("b").over(w)}).where(own & F.col("a0").isNotNull())
    u, v = S.times_conjugate(F.col("a"), F.col("b"), F.col("a0"), F.col("b0"))
    out = x.groupBy("pixel").agg(F.avg(u).alias("u"), F.avg(v).alias("v"))
    return out.select("pixel", (prf / (2 * math.pi * gap) * F.atan2("v", "u")).alias("doppler"))


def noise_trimmed(image: DataFrame, block: int) -> DataFrame:
    """Noise per block of pixels: half the mean power of differences of neighbouring lines, once more over those under twice its root."""
    x, w, own = with_halo(image, 1, 0)
    gap = x.withColumns({"dr": F.col("re") - F.lag("re").over(w), "di": F.col("im") - F.lag("im").over(w)}).where(own & F.col("dr").isNotNull())
    gap = gap.select(F.floor(F.col("pixel") / block).alias("block"), S.power(F.col("dr"), F.col("di")).alias("p"))
    first = gap.groupBy("block").agg(F.avg("p").alias("m"))
    return gap.join(first, "block").where(F.sqrt("p") < 2 * F.sqrt("m")).groupBy("block").agg((0.5 * F.avg("p")).alias("noise"))


def noise_by_eigenvalue(image: DataFrame, lines: int) -> DataFrame:
    """Noise power: the median over blocks of ``lines`` lines of the least eigenvalue of their covariance."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = (pdf.pivot_table(index="line", columns="pixel", values="re", fill_value=0).to_numpy() + 1j * pdf.pivot_table(index="line", columns="pixel", values="im", fill_value=0).to_numpy())
        return pd.DataFrame({"block": [key[0]], "least": [float(np.linalg.eigvalsh(z @ z.conj().T / z.shape[1])[0])]})

    blocks = image.withColumn("block", F.floor(F.col("line") / lines)).groupBy("block").applyInPandas(run, "block long, least double")
    return blocks.agg(F.median("least").alias("noise"), F.count("*").alias("blocks"))


def _quad(p: str) -> tuple[Column, Column]:
    return F.col(f"{p}_re"), F.col(f"{p}_im")


def _cross(q: DataFrame) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    hh, hv, vh, vv = (_quad(p) for p in ("hh", "hv", "vh", "vv"))
    return (vh[0] - hv[0], vh[1] - hv[1]), (hh[0] + vv[0], hh[1] + vv[1])


def faraday_by_powers(quad: DataFrame, lines: int) -> DataFrame:
    """Rotation per block of lines by the ratio of cross to like power, with the sign of the mean ratio's real part; its size is known to a quarter turn."""
    (a, b), (c, d) = _cross(quad)
    re, _ = S.times_conjugate(a, b, c, d)
    power = S.power(c, d)
    out = quad.groupBy(F.floor(F.col("line") / lines).alias("block")).agg(F.avg(S.power(a, b)).alias("x"), F.avg(power).alias("y"), F.avg(F.try_divide(re, power)).alias("s"))
    angle = 0.5 * F.signum("s") * F.atan(F.sqrt(F.col("x") / F.col("y")))
    return out.select("block", angle.alias("rotation"), F.sqrt(F.col("x") + F.col("y")).alias("magnitude"))


def faraday_of_reflector(chips: DataFrame) -> DataFrame:
    """Rotation per reflector (id) from its brightest sample: half the arctangent of Re((VH - HV) / (HH + VV))."""
    (a, b), (c, d) = _cross(chips)
    re, _ = S.times_conjugate(a, b, c, d)
    ratio = F.try_divide(re, S.power(c, d))
    best = chips.groupBy("id").agg(F.max_by(ratio, F.struct(S.power(c, d), -F.col("line"), -F.col("pixel"))).alias("r"))
    return best.select("id", (0.5 * F.atan("r")).alias("rotation"))


def channel_imbalance(quad: DataFrame, lines: int) -> DataFrame:
    """Receive imbalance per block of lines, <VH conj HV> / <|HV|**2>: amplitude and phase."""
    hv, vh = _quad("hv"), _quad("vh")
    re, im = S.times_conjugate(*vh, *hv)
    out = quad.groupBy(F.floor(F.col("line") / lines).alias("block")).agg(F.avg(re).alias("x"), F.avg(im).alias("y"), F.avg(S.power(*hv)).alias("p"))
    return out.select("block", F.try_divide(F.hypot("x", "y"), F.col("p")).alias("amplitude"), F.atan2("y", "x").alias("phase"))


def echo_pattern(image: DataFrame, pixels: int) -> DataFrame:
    """Mean echo power per range block, in decibels."""
    out = image.groupBy(F.floor(F.col("pixel") / pixels).alias("block")).agg(F.avg(S.power(F.col("re"), F.col("im"))).alias("p"))
    return out.select("block", (10 * F.log10("p")).alias("power"))


def polynomial_fit(points: DataFrame, degree: int) -> DataFrame:
    """Least-squares polynomial per group (group, x, y): sums of monomials in Spark, one small system a group after.

    x should be near the unit interval, as powers up to 2 * degree are summed.
    """
    x, y = F.col("x"), F.col("y")
    power = [F.lit(1.0)]
    for _ in range(2 * degree):
        power.append(power[-1] * x)
    sums = points.groupBy("group").agg(F.array(*(F.sum(p) for p in power)).alias("a"), F.array(*(F.sum(p * y) for p in power[: degree + 1])).alias("b"))

    @F.pandas_udf("array<double>")
    def solved(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=object)
        m, v = np.stack(a.to_numpy()), np.stack(b.to_numpy())
        at = np.arange(degree + 1)
        return pd.Series(list((np.linalg.pinv(m[:, at[:, None] + at]) @ v[..., None])[..., 0]))

    return sums.select("group", solved("a", "b").alias("coefficients"))


def bivariate_fit(points: DataFrame, degree: int) -> DataFrame:
    """Least-squares polynomial in x and y per group (group, x, y, v), of total degree ``degree``: terms x**i y**j by degree, then by i."""
    terms = [(i, d - i) for d in range(degree + 1) for i in range(d + 1)]
    mono = [F.pow("x", F.lit(i)) * F.pow("y", F.lit(j)) for i, j in terms]
    n = len(terms)
    sums = points.groupBy("group").agg(F.array(*(F.sum(p * q) for p in mono for q in mono)).alias("a"), F.array(*(F.sum(p * F.col("v")) for p in mono)).alias("b"))

    @F.pandas_udf("array<double>")
    def solved(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=object)
        return pd.Series(list((np.linalg.pinv(np.stack(a.to_numpy()).reshape(-1, n, n)) @ np.stack(b.to_numpy())[..., None])[..., 0]))

    return sums.select("group", solved("a", "b").alias("coefficients"))


def masked_extrema(raster: DataFrame) -> DataFrame:
    return raster.where("mask").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def spans_union(spans: DataFrame, by: str) -> DataFrame:
    """The whole time that a group's spans (t0, t1) reach over."""
    return spans.groupBy(by).agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))


def median_deviation(values: DataFrame) -> DataFrame:
    """Median and median absolute deviation per group, exactly: values put in order within their group by Spark's sort-based percentile."""
    m = values.groupBy("group").agg(F.median("value").alias("median"))
    x = values.join(m, "group").withColumn("d", F.abs(F.col("value") - F.col("median")))
    return x.groupBy("group", "median").agg(F.median("d").alias("mad"))


def repetition(pulses: DataFrame, by: str) -> DataFrame:
    """Mean and greatest pulse repetition frequency per group of pulses (t)."""
    w = Window.partitionBy(by).orderBy("t")
    x = pulses.withColumn("gap", F.col("t") - F.lag("t").over(w)).where("gap > 0")
    return x.groupBy(by).agg((1 / F.avg("gap")).alias("mean"), (1 / F.min("gap")).alias("highest"))


def values_of(rows: DataFrame, by: str, column: str) -> DataFrame:
    """The sorted set of a column's values per group; for columns of few values, as frequencies or polarisations."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_set(column)).alias("values"))


def smoothed(raster: DataFrame, rows: list[float], columns: list[float], step: tuple[int, int] = (1, 1)) -> DataFrame:
    """Separable filter of weighted samples (value, weight), decimated: sum(k w x) / sum(k w), 0 where that weight is 0, null where the sample's own weight is.

    Along lines first, then down columns in blocks with a halo.
    """
    x = raster.withColumn("wx", F.col("weight") * F.col("value"))

    def taps(c: str, kernel: list[float], over) -> Column:
        half, out = len(kernel) // 2, F.lit(0.0)
        for i, k in enumerate(kernel):
            out = out + F.coalesce((F.col(c) if i == half else F.lag(c, half - i).over(over)) * k, F.lit(0.0))
        return out

    x = x.withColumns({"a": taps("wx", columns, along()), "b": taps("weight", columns, along())}).where(F.col("pixel") % step[1] == 0)
    half = len(rows) // 2
    x, over, own = with_halo(x, half, half)
    x = x.withColumns({"s": taps("a", rows, over), "n": taps("b", rows, over)}).where(own & (F.col("line") % step[0] == 0))
    value = F.when(F.col("weight") == 0, None).when(F.col("n") == 0, 0.0).otherwise(F.try_divide("s", "n"))
    return x.select(F.floor(F.col("line") / step[0]).alias("line"), F.floor(F.col("pixel") / step[1]).alias("pixel"), value.alias("value"))


def median2d(raster: DataFrame) -> DataFrame:
    """Median of the 3 x 3 samples about each; edges are mirrored with the edge sample itself repeated."""
    v = F.col("value")
    a = along()
    x = raster.withColumn("row", F.array(F.coalesce(F.lag(v).over(a), v), v, F.coalesce(F.lead(v).over(a), v)))
    x, over, own = with_halo(x, 1, 1)
    nine = F.concat(F.coalesce(F.lag("row").over(over), F.col("row")), F.col("row"), F.coalesce(F.lead("row").over(over), F.col("row")))
    return x.withColumn("s", F.array_sort(nine)).where(own).select("line", "pixel", F.get("s", F.lit(4)).alias("value"))


def boxcar(raster: DataFrame, half: int) -> DataFrame:
    """Sum of the square of samples about each, zero outside the raster, over their fixed number."""
    x = raster.withColumn("s", F.sum("value").over(along().rowsBetween(-half, half)))
    x, over, own = with_halo(x, half, half)
    total = F.sum("s").over(over.rowsBetween(-half, half))
    return x.withColumn("value", total / (2 * half + 1) ** 2).where(own).select("line", "pixel", "value")


def smooth_gradient(image: DataFrame, size: int, shape: tuple[int, int]) -> DataFrame:
    """Phase steps across and along, from products with the sample before summed under a Gaussian window of ``size``; 0 near the edges."""
    half = size // 2
    g = [math.exp(-(k * k) / (size / 2)) for k in range(-half, half + 1)]
    a = along()
    x = image.withColumns({"lr": F.lag("re").over(a), "li": F.lag("im").over(a)})
    x, over, own = with_halo(x, half + 1, half)
    x = x.withColumns({"ur": F.lag("re").over(over), "ui": F.lag("im").over(over)})
    z = F.col("re"), F.col("im")
    (xr, xi), (yr, yi) = S.times_conjugate(*z, F.col("lr"), F.col("li")), S.times_conjugate(*z, F.col("ur"), F.col("ui"))
    x = x.withColumns({"xr": xr, "xi": xi, "yr": yr, "yi": yi})
    across = Window.partitionBy("block", "line").orderBy("pixel")

    def taps(c: str, w) -> Column:
        out = F.lit(0.0)
        for i, k in enumerate(g):
            out = out + F.coalesce((F.col(c) if i == half else F.lag(c, half - i).over(w)) * k, F.lit(0.0))
        return out

    x = x.withColumns({c: taps(c, across) for c in ("xr", "xi", "yr", "yi")})
    x = x.withColumns({c: taps(c, over) for c in ("xr", "xi", "yr", "yi")}).where(own)
    inside = (F.col("line") > half) & (F.col("line") < shape[0] - half) & (F.col("pixel") > half) & (F.col("pixel") < shape[1] - half)
    return x.select("line", "pixel", F.when(inside, F.atan2("xi", "xr")).otherwise(0.0).alias("across"), F.when(inside, F.atan2("yi", "yr")).otherwise(0.0).alias("along"))


def neutrons(image: DataFrame, shape: tuple[int, int], step: float, bright: float, coherence: float, pad: tuple[int, int] = (16, 32), every: int = 4) -> DataFrame:
    """Samples to cut from unwrapping (line, pixel, re, im, across, corr): steep phase, or brightness over mean + bright * deviation with corr below ``coherence``.

    Mean and deviation come from every ``every``-th sample inside the padding.
    """
    p = S.power(F.col("re"), F.col("im"))
    some = image.where((F.col("line") >= pad[0]) & (F.col("line") < shape[0] - pad[0]) & (F.col("pixel") >= pad[1]) & (F.col("pixel") < shape[1] - pad[1]))
    some = some.where(((F.col("line") - pad[0]) % every == 0) & ((F.col("pixel") - pad[1]) % every == 0))
    mean, dev = some.agg(F.avg(p), F.stddev_pop(p)).first()
    bright_ = (p > (mean + bright * dev)) & (F.col("corr") < coherence) if mean is not None else F.lit(False)
    return image.select("line", "pixel", ((F.abs("across") > step) | bright_).alias("neutron"))


def sharp_hits(power: DataFrame, width: int, p_value: float, trim: float, axis: str = "line", group: str = "pixel", detrend: bool = False) -> DataFrame:
    """How many windows that hold a sample stand out, by the upper tail of a normal score against the trimmed mean and deviation over ``group``.

    Windows of ``width`` samples along ``axis`` are averaged (narrow-band: over lines, compared
    over pixels); wide-band takes logarithms and a linear trend off first. A window at i counts
    for samples i .. i + width - 1.
    """
    cut = normal_quantile(1 - p_value)
    ahead = Window.partitionBy(group).orderBy(axis).rowsBetween(0, width - 1)
    x = power.withColumns({"m": F.avg("value").over(ahead), "k": F.count("*").over(ahead)}).where(F.col("k") == width)
    if detrend:
        x = x.withColumn("m", F.log10("m"))
        g = F.col(group).cast("double")
        fit = x.groupBy(axis).agg(F.regr_slope("m", g).alias("slope"), F.regr_intercept("m", g).alias("base"))
        x = x.join(fit, axis).withColumn("m", F.col("m") - F.col("base") - F.col("slope") * g)
    w = Window.partitionBy(axis)
    ranked = x.withColumns({"i": F.row_number().over(w.orderBy("m")), "n": F.count("*").over(w)})
    c = F.rint(F.col("n") * (0.5 * trim))
    stats = ranked.where((F.col("i") > c) & (F.col("i") <= F.col("n") - c)).groupBy(axis).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("dev"))
    hit = x.join(stats, axis).select("line", "pixel", ((F.col("m") - F.col("mean")) > cut * F.col("dev")).cast("int").alias("hit"))
    back = Window.partitionBy(group).orderBy(axis).rowsBetween(-(width - 1), 0)
    both = power.select("line", "pixel").join(hit, ["line", "pixel"], "left")
    return both.select("line", "pixel", F.coalesce(F.sum("hit").over(back), F.lit(0)).alias("hits"))


def normal_quantile(p: float) -> float:
    """The normal score below which a share p lies, by Newton's steps on the error function."""
    x = 0.0
    for _ in range(100):
        step = (0.5 * math.erfc(-x / math.sqrt(2)) - p) / (math.exp(-x * x / 2) / math.sqrt(2 * math.pi))
        x -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-14:
            break
    return x


def last_steep(values: DataFrame, cut: float, most: int) -> DataFrame:
    """Per group of eigenvalues (group, values in descending order): one past the last place before ``most`` with a step of more than ``cut`` decibels down; 0 if none."""
    db = F.transform("values", lambda v: 10 * F.log10(F.abs(v)))
    step = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.when(F.get("db", i + 1) - F.get("db", i) < -cut, i + 1).otherwise(0))
    return values.withColumn("db", db).select("group", F.array_max(step).alias("signals"))


def edges(raster: DataFrame, cut: float) -> DataFrame:
    """Samples whose gradient (three by three Sobel sums) is over ``cut`` and is the largest along its own direction, rounded to eighths of a turn."""
    a = along()
    v = F.col("value")
    x = raster.withColumns({"d": F.lead(v).over(a) - F.lag(v).over(a), "s": F.lead(v).over(a) + 2 * v + F.lag(v).over(a)})
    x, over, own = with_halo(x, 2, 2)
    gx = F.lag("d").over(over) + 2 * F.col("d") + F.lead("d").over(over)
    gy = F.lead("s").over(over) - F.lag("s").over(over)
    x = x.withColumns({"gx": gx, "gy": gy}).withColumn("g", F.hypot("gx", "gy"))
    x = x.withColumn("turn", F.pmod(F.round(F.atan2("gy", "gx") / (math.pi / 4)), F.lit(4)))
    across = Window.partitionBy("block", "line").orderBy("pixel")
    near = {0: (F.lag("g").over(across), F.lead("g").over(across)), 2: (F.lag("g").over(over), F.lead("g").over(over))}
    x = x.withColumns({"gl": near[0][0], "gr": near[0][1], "gu": near[2][0], "gd": near[2][1]})
    x = x.withColumns({"ul": F.lag("gu").over(across), "ur": F.lead("gu").over(across), "dl": F.lag("gd").over(across), "dr": F.lead("gd").over(across)})
    pair = F.when(F.col("turn") == 0, F.array("gl", "gr")).when(F.col("turn") == 2, F.array("gu", "gd")).when(F.col("turn") == 1, F.array("ul", "dr")).otherwise(F.array("ur", "dl"))
    least = F.array_max(F.transform(pair, lambda p: F.coalesce(p, F.lit(0.0))))
    return x.where(own & (F.col("g") > cut) & (F.col("g") >= least)).select("line", "pixel", F.col("g").alias("strength"))


def nulls_beside_peak(raster: DataFrame) -> DataFrame:
    """Per line the nearest local minima before and after its largest sample: line, peak, left, right (null where the line has none)."""
    w = Window.partitionBy("line")
    a = along()
    x = raster.withColumns({"low": (F.col("value") < F.lag("value").over(a)) & (F.col("value") < F.lead("value").over(a)), "peak": F.max_by("pixel", F.struct(F.col("value"), -F.col("pixel"))).over(w)})
    left = F.max(F.when(F.col("low") & (F.col("pixel") < F.col("peak")), F.col("pixel")))
    right = F.min(F.when(F.col("low") & (F.col("pixel") > F.col("peak")), F.col("pixel")))
    return x.groupBy("line", "peak").agg(left.alias("left"), right.alias("right"))


def outlier_mask(raster: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Whether a sample is within ``sigmas`` deviations, over the raster, of the 3 x 3 median about it."""
    m = median2d(raster).withColumnRenamed("value", "median")
    x = raster.join(m, ["line", "pixel"])
    dev = x.agg(F.stddev_pop(F.col("value") - F.col("median"))).first()[0] or 0.0
    return x.select("line", "pixel", (F.abs(F.col("value") - F.col("median")) < sigmas * dev).alias("valid"))


def regions(mask: DataFrame, least: int) -> DataFrame:
    """Connected regions (four neighbours) of the samples that are set, without those of fewer than ``least`` samples: line, pixel, region, size.

    Runs along a line are found by windows; runs of neighbouring lines that touch are linked,
    and the links' components, rounds of taking the smaller label, name the regions.
    """
    a = along()
    on = mask.where("mask").select("line", "pixel")
    new = F.coalesce(F.col("pixel") - F.lag("pixel").over(a) != 1, F.lit(True))
    runs = on.withColumn("begin", F.last(F.when(new, F.col("pixel")), ignorenulls=True).over(a)).groupBy("line", "begin").agg(F.max("pixel").alias("end"), F.count("*").alias("n"))
    runs = written(runs.withColumn("run", F.col("line") * (1 << 24) + F.col("begin")), "runs")
    # a run meets the runs of the next line by cells of 64 pixels
    cells = F.explode(F.sequence(F.floor(F.col("begin") / 64), F.floor(F.col("end") / 64)))
    below = runs.select((F.col("line") - 1).alias("line"), F.col("begin").alias("b2"), F.col("end").alias("e2"), F.col("run").alias("v")).withColumn("cell", F.explode(F.sequence(F.floor(F.col("b2") / 64), F.floor(F.col("e2") / 64))))
    links = runs.withColumn("cell", cells).join(below, ["line", "cell"]).where((F.col("begin") <= F.col("e2")) & (F.col("b2") <= F.col("end")))
    links = links.select(F.col("run").alias("u"), "v").distinct()
    label = runs.select("run", F.col("run").alias("region"))
    both = written(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links")
    changed = True
    while changed:
        near = both.join(label.select(F.col("run").alias("v"), "region"), "v").groupBy("u").agg(F.min("region").alias("least"))
        step = label.join(near, label.run == near.u, "left").select("run", F.least("region", F.coalesce("least", "region")).alias("region"))
        # and the label of the label, so paths halve
        jump = step.select(F.col("run").alias("r"), F.col("region").alias("up"))
        then = written(step.join(jump, step.region == jump.r).select("run", F.col("up").alias("region")), "labels")
        changed = then.join(label.withColumnRenamed("region", "was"), "run").where("region <> was").limit(1).count() > 0
        label = then
    sizes = runs.join(label, "run")
    total = sizes.groupBy("region").agg(F.sum("n").alias("size")).where(F.col("size") >= least)
    x = sizes.join(total, "region")
    return x.select("line", F.explode(F.sequence("begin", "end")).alias("pixel"), "region", "size")
