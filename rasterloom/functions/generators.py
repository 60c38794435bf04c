"""Axes, chirps and filter kernels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def linspace(spark: SparkSession, first: float, step: float, n: int, name: str = "value") -> DataFrame:
    return spark.range(n).select(F.col("id").alias("place"), (first + F.col("id") * step).alias(name))


def logspace(spark: SparkSession, first: float, step: float, n: int, name: str = "value") -> DataFrame:
    """Powers of ten with evenly spaced exponents."""
    return spark.range(n).select(F.col("id").alias("place"), F.pow(F.lit(10.0), first + F.col("id") * step).alias(name))


def chirp(spark: SparkSession, rate: float, duration: float, sampling: float, centre: float = 0.0, amplitude: float = 1.0) -> DataFrame:
    """A linear chirp of a rate in Hz a second, symmetric about its middle: place, re, im."""
    n = int(duration * sampling)
    t = (F.col("id") - (n - 1) / 2) / sampling
    angle = math.pi * (2 * centre * t + rate * t * t)
    return spark.range(n).select(F.col("id").alias("place"), (amplitude * F.cos(angle)).alias("re"), (amplitude * F.sin(angle)).alias("im"))


def boxcar(n: int) -> list[float]:
    return [1 / n] * n


def delta(n: int) -> list[float]:
    return [1.0 if i == n // 2 else 0.0 for i in range(n)]


def gaussian(n: int, sigma: float) -> list[float]:
    """Samples of a bell curve, summing to 1."""
    g = [math.exp(-((i - n // 2) ** 2) / (2 * sigma * sigma)) for i in range(n)]
    return [x / sum(g) for x in g]


def outer(rows: list[float], columns: list[float]) -> list[list[float]]:
    """A two-dimensional kernel of two of one dimension."""
    return [[a * b for b in columns] for a in rows]


def next_fast(n: int) -> int:
    """The least number not under n that has no prime factors but 2, 3 and 5."""
    best = 1 << max(0, (n - 1).bit_length())
    a = 1
    while a < best:
        b = a
        while b < best:
            c = b
            while c < n:
                c *= 2
            best = min(best, c)
            b *= 3
        a *= 5
    return best


#: Interpolation kernels of an offset in samples, by name; each Column to Column.
def bartlett(width: float):
    return lambda x: F.greatest(1 - F.abs(x) / (width / 2), F.lit(0.0))


def linear():
    return bartlett(2.0)


def cubic(a: float = -0.5):
    def run(x: Column) -> Column:
        m = F.abs(x)
        return F.when(m <= 1, (a + 2) * m * m * m - (a + 3) * m * m + 1).when(m < 2, a * (m * m * m - 5 * m * m + 8 * m - 4)).otherwise(0.0)

    return run


def knab(width: float, bandwidth: float):
    """A sinc under a hyperbolic cosine window, for signals that fill ``bandwidth`` of the samples' band."""
    b = math.pi * (1 - bandwidth) * width / 2

    def run(x: Column) -> Column:
        from .scalar import sinc

        u = F.sqrt(F.greatest(1 - F.pow(2 * x / width, F.lit(2.0)), F.lit(0.0)))
        return F.when(F.abs(x) > width / 2, 0.0).otherwise(sinc(x) * F.cosh(b * u) / math.cosh(b))

    return run


KERNELS = {"bartlett": bartlett, "linear": linear, "cubic": cubic, "knab": knab}


def interpolated(samples: Column, at: Column, kernel, taps: int) -> Column:
    """The value of an array at a place by a kernel over ``taps`` samples about it; samples outside count as 0."""
    first = F.ceil(at - taps / 2).cast("int")
    out = F.lit(0.0)
    for k in range(taps):
        i = first + k
        out = out + F.coalesce(F.when(i >= 0, F.get(samples, i)), F.lit(0.0)) * kernel(at - i)
    return out
