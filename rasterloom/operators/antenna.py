"""Antenna channels: beamforming, seamless one-tap switching, presum weights, interference taken out of samples, and sets of channels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def weights(patterns: DataFrame) -> DataFrame:
    """Receive weights (channel, angle, re, im) that add the channels' patterns in phase, with power 1 over the channels of an angle."""
    w = Window.partitionBy("angle")
    size = F.sqrt(F.sum(S.power(F.col("re"), F.col("im"))).over(w))
    return patterns.select("channel", "angle", F.try_divide("re", size).alias("re"), F.try_divide(-F.col("im"), size).alias("im"))


def beamformed(samples: DataFrame, table: DataFrame) -> DataFrame:
    """Sum over channels of samples (line, pixel, channel, angle, re, im) times the weight of their channel and angle; the table of weights is joined on both."""
    t = table.select("channel", "angle", F.col("re").alias("wr"), F.col("im").alias("wi"))
    x = samples.join(t, ["channel", "angle"])
    re, im = F.col("re") * F.col("wr") - F.col("im") * F.col("wi"), F.col("re") * F.col("wi") + F.col("im") * F.col("wr")
    return x.groupBy("line", "pixel").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def one_tap(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """Of samples (line, pixel, channel, re, im) those of the channel whose span [start, stop) of pixels holds them: one for each place; the lowest channel of two."""
    x = samples.join(spans, "channel").where((F.col("pixel") >= F.col("start")) & (F.col("pixel") < F.col("stop")))
    best = F.min_by(F.struct("channel", "re", "im"), "channel")
    return x.groupBy("line", "pixel").agg(best.alias("b")).select("line", "pixel", "b.*")


def presum_weights(gaps: np.ndarray, place: float, bandwidth: float) -> np.ndarray:
    """The linear unbiased weights of irregular samples at ``gaps`` for a place, of least error for a band of ``bandwidth`` (sinc correlation)."""
    lag = np.sinc(bandwidth * (gaps[:, None] - gaps[None, :]))
    w = np.linalg.lstsq(lag + 1e-9 * np.eye(len(gaps)), np.sinc(bandwidth * (gaps - place)), rcond=None)[0]
    return w / w.sum() if abs(w.sum()) > 1e-12 else w


def presummed(windows: DataFrame, bandwidth: float) -> DataFrame:
    """Output samples (out, re, im) from rows (out, t, times, re, im: the pulses about each output time)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for out, t, times, re, im in zip(pdf["out"], pdf["t"], pdf["times"], pdf["re"], pdf["im"], strict=True):
                w = presum_weights(np.asarray(times, float), float(t), bandwidth) if len(times) else np.empty(0)
                rows.append((out, float(w @ np.asarray(re, float)), float(w @ np.asarray(im, float))))
            yield pd.DataFrame(rows, columns=["out", "re", "im"])

    return windows.select("out", "t", "times", "re", "im").mapInPandas(run, "out long, re double, im double")


def without_interference(image: DataFrame, lines: int, cut: float) -> DataFrame:
    """Samples without the components of each block's ``lines`` lines whose eigenvalue is over ``cut`` times the median: line, pixel, re, im.

    A block is ``lines`` lines by all their pixels, a size that the sensor fixes.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, at = np.unique(pdf["line"], return_inverse=True)
        columns, to = np.unique(pdf["pixel"], return_inverse=True)
        z = np.zeros((len(rows), len(columns)), complex)
        z[at, to] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        values, vectors = np.linalg.eigh(z @ z.conj().T / z.shape[1])
        bad = vectors[:, values > cut * max(np.median(values), 1e-300)]
        z = z - bad @ (bad.conj().T @ z)
        return pd.DataFrame({"line": pdf["line"].to_numpy(), "pixel": pdf["pixel"].to_numpy(), "re": z[at, to].real, "im": z[at, to].imag})

    return image.withColumn("block", F.floor(F.col("line") / lines)).groupBy("block").applyInPandas(run, "line long, pixel long, re double, im double")


def regular_channels(channels: DataFrame) -> DataFrame:
    """Channels (freq, pol, lo, hi) with one band for each frequency name: where a name has two bands, the higher is named B.

    Bands of no width are left out; more than two bands of one name and polarisation are an error.
    """
    w = Window.partitionBy("freq", "pol")
    x = channels.where("lo < hi").distinct().withColumns({"i": F.row_number().over(w.orderBy((F.col("lo") + F.col("hi")) / 2)), "n": F.count("*").over(w)})
    name = F.when(F.col("n") > 2, F.raise_error(F.lit("more than two bands of one channel"))).when((F.col("n") == 2) & (F.col("i") == 2), "B").otherwise(F.col("freq"))
    return x.select(name.alias("freq"), "pol", "lo", "hi").distinct()


def held(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once, however often ``use`` has it: a column named in an expression is written out at each place, so nested steps would grow as powers."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def polygon_area(corners: Column) -> Column:
    """Area of a polygon, an array of (x, y) structs without the first repeated."""

    def area(p: Column) -> Column:
        both = F.zip_with(p, F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1)), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
        return F.abs(F.aggregate(both, F.lit(0.0), lambda s, x: s + x)) / 2

    return held(corners, area)


def clipped(corners: Column, box: tuple[float, float, float, float]) -> Column:
    """A polygon cut to a box (x0, y0, x1, y1): each side of the box in turn."""

    def side(p: Column, axis: str, limit: float, keep_over: bool) -> Column:
        other = "y" if axis == "x" else "x"
        inside = lambda q: q[axis] >= limit if keep_over else q[axis] <= limit

        def cross(a: Column, b: Column) -> Column:
            at = a[other] + (limit - a[axis]) / (b[axis] - a[axis]) * (b[other] - a[other])
            return F.struct(F.lit(limit).alias("x"), at.alias("y")) if axis == "x" else F.struct(at.alias("x"), F.lit(limit).alias("y"))

        same = lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))
        none = F.array().cast("array<struct<x:double,y:double>>")
        step = lambda a, b: F.when(inside(a) & inside(b), F.array(same(b))).when(inside(a), F.array(cross(a, b))).when(inside(b), F.array(cross(a, b), same(b))).otherwise(none)
        n = F.size(p)
        return F.flatten(F.zip_with(p, F.concat(F.slice(p, 2, n), F.slice(p, 1, 1)), step))

    def cut(*at: object) -> Callable[[Column], Column]:
        return lambda p: F.when(F.size(p) > 0, side(p, *at)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))

    for at in (("x", box[0], True), ("x", box[2], False), ("y", box[1], True), ("y", box[3], False)):
        corners = held(corners, cut(*at))
    return corners


def low_pass(taps: int, cut: float, beta: float = 6.0) -> list[float]:
    """A Kaiser-windowed low-pass filter of cut frequency in cycles a sample, with gain 1 at zero."""
    k = np.arange(taps) - (taps - 1) / 2
    h = 2 * cut * np.sinc(2 * cut * k) * np.kaiser(taps, beta)
    return (h / h.sum()).tolist()


def multirate(samples: Column, taps: list[float], up: int, down: int) -> Column:
    """An array at up / down times its rate through a filter of the higher rate; no sample of the higher rate is made that is not kept."""
    n, half = F.size(samples), len(taps) // 2
    count = F.greatest(F.ceil(n * up / down).cast("int"), F.lit(0))

    def at(i: Column) -> Column:
        out = F.lit(0.0)
        for k, h in enumerate(taps):
            j = i * down + half - k
            out = out + F.when((j % up == 0) & (j >= 0) & (j < n * up), F.get(samples, (j / up).cast("int")) * (h * up)).otherwise(0.0)
        return out

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(F.array().cast("array<double>"))


def joint_sort(keys: Column, values: Column) -> tuple[Column, Column]:
    """Two arrays in the order of the first."""
    pairs = F.array_sort(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v"))))
    return F.transform(pairs, lambda p: p["k"]), F.transform(pairs, lambda p: p["v"])


def last_not_over(ordered: Column, x: Column) -> Column:
    """The place (from 0) of the last value of an ordered array that is not over x, at least 0."""
    return F.greatest(F.size(F.filter(ordered, lambda v: v <= x)) - 1, F.lit(0))
