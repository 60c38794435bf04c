"""Chains of operators: named steps whose tables are written, so a run goes on where another stopped."""

from __future__ import annotations

import argparse
import math
from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates, estimators, geometry, imaging, kernels, pixelwise, predicates, unwrap
from .sources import formats, rasters

Tables = dict[str, DataFrame]


class Reader(Protocol):
    """What opens a product: its tables by name."""

    def __call__(self, spark: SparkSession, folder: str) -> Tables: ...


class Estimator(Protocol):
    """What turns co-registered tables into a table of estimates: rotation of polarisation, ionosphere, antenna weights."""

    def __call__(self, rows: DataFrame, **options) -> DataFrame: ...


class Workflow:
    """Steps in order, each a function of the tables so far that returns its own; every step's table is written below ``folder``.

    A later run takes the steps that are there, marked as done when written whole, and begins
    with the first that is not.
    """

    def __init__(self, steps: list[tuple[str, Callable[[Tables, dict], DataFrame]]]):
        self.steps = steps

    def done(self, spark: SparkSession, folder: str) -> list[str]:
        out = []
        for name, _ in self.steps:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
            if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                break
            out.append(name)
        return out

    def run(self, spark: SparkSession, tables: Tables, folder: str, options: dict | None = None, restart: bool = False) -> Tables:
        held, there = dict(tables), set() if restart else set(self.done(spark, folder))
        for name, step in self.steps:
            if name not in there:
                step(held, options or {}).write.mode("overwrite").parquet(f"{folder}/{name}")
            held[name] = spark.read.parquet(f"{folder}/{name}")
        return held


def _looks(t: Tables, o: dict) -> DataFrame:
    """Looked-down interferogram of the lines of two images."""
    return aggregates.multilook_interferogram(pixelwise.pair_lines(t["reference"], t["secondary"]), o.get("lines", 4), o.get("pixels", 4), o.get("shape"))


def _smooth(t: Tables, o: dict) -> DataFrame:
    """Real and imaginary part under a boxcar, and the phase of that."""
    x, half = t["interferogram"], o.get("half", 1)
    re = estimators.boxcar(x.select("line", "pixel", F.col("re").alias("value")), half).withColumnRenamed("value", "re")
    im = estimators.boxcar(x.select("line", "pixel", F.col("im").alias("value")), half).withColumnRenamed("value", "im")
    y = re.join(im, ["line", "pixel"]).join(x.select("line", "pixel", "coherence"), ["line", "pixel"])
    return y.select("line", "pixel", "re", "im", F.atan2("im", "re").alias("phase"), "coherence")


def _prepared(t: Tables, o: dict) -> DataFrame:
    """Phase where coherence is enough; elsewhere filled from near samples."""
    x = t["filter"].select("line", "pixel", F.when(F.col("coherence") >= o.get("coherence", 0.0), F.col("phase")).alias("value"))
    from .operators.lookups import nearest_fill

    return nearest_fill(x, o.get("reach", 8))


def _unwrapped(t: Tables, o: dict) -> DataFrame:
    return unwrap.unwrapped(rasters.line_arrays(t["prepare"].where("value is not null")), o.get("block", 64))


#: Two images (reference, secondary: lines of interleaved parts) to unwrapped phase.
INTERFEROMETRY = Workflow([("interferogram", _looks), ("filter", _smooth), ("prepare", _prepared), ("unwrap", _unwrapped)])


def _symmetric(t: Tables, o: dict) -> DataFrame:
    return t["quad"].select("line", "pixel", "hh_re", "hh_im", *(((F.col(f"hv_{p}") + F.col(f"vh_{p}")) * 0.5).alias(f"hv_{p}") for p in ("re", "im")), "vv_re", "vv_im")


def _terms(t: Tables, o: dict) -> DataFrame:
    return aggregates.covariance(t["symmetrise"], ["hh", "hv", "vv"], o.get("lines", 20))


def _projected(t: Tables, o: dict) -> DataFrame:
    """Backscatter spread over a map grid by each cell's footprint."""
    x = t["symmetrise"].select((F.col("line") * 0.3).alias("y0"), (F.col("line") * 0.3 + 0.8).alias("y1"), (F.col("pixel") * 0.4).alias("x0"), (F.col("pixel") * 0.4 + 0.9).alias("x1"), (F.col("hh_re") ** 2 + F.col("hh_im") ** 2).alias("value"))
    return imaging.area_geocode(x)


#: Quad-polarised samples to covariance terms and a map of backscatter.
COVARIANCE = Workflow([("symmetrise", _symmetric), ("covariance", _terms), ("geocode", _projected)])


def _gaps(t: Tables, o: dict) -> DataFrame:
    return predicates.fill_gaps(t["echo"], t["swaths"])


def _clean(t: Tables, o: dict) -> DataFrame:
    """Lines without narrow-band interference."""
    x = t["fill"].groupBy("line").agg(F.array_sort(F.collect_list(F.struct("pixel", "re", "im"))).alias("z"))
    x = x.select("line", F.transform("z", lambda z: z["re"]).alias("re"), F.transform("z", lambda z: z["im"]).alias("im"))
    return kernels.notch(x, o.get("cut", 50.0))


def _compress(t: Tables, o: dict) -> DataFrame:
    n = o.get("chirp", 8)
    replica = np.exp(1j * math.pi * o.get("rate", 4.0) * (np.arange(n) / n - 0.5) ** 2)
    re = kernels.compressed(t["interference"].select("line", F.col("re").alias("values")), replica, "same").withColumnsRenamed({"re": "a", "im": "b"})
    im = kernels.compressed(t["interference"].select("line", F.col("im").alias("values")), replica, "same").withColumnsRenamed({"re": "c", "im": "d"})
    y = re.join(im, "line")
    return y.select("line", F.zip_with("a", "d", lambda a, d: a - d).alias("re"), F.zip_with("b", "c", lambda b, c: b + c).alias("im"))


def _focus(t: Tables, o: dict) -> DataFrame:
    x = t["compress"].select("line", F.posexplode(F.arrays_zip("re", "im")).alias("pixel", "z")).select("line", F.col("pixel").cast("long").alias("pixel"), "z.re", "z.im")
    return imaging.back_projection(x, t["targets"], o.get("aperture", 4), o.get("wavelength", 0.24), o.get("spacing", 0.3))


#: Echoes (echo: samples, swaths, targets) to focused targets.
FOCUS = Workflow([("fill", _gaps), ("interference", _clean), ("compress", _compress), ("focus", _focus)])


def _geocode(t: Tables, o: dict) -> DataFrame:
    return geometry.geocoded_slc(t["lines"], t["places"], geometry.orbit_of(t["orbit"]), o["wavelength"], o["start"], o["prf"], o["near"], o["spacing"])


#: An image in radar geometry (lines, orbit, places) to a map.
GEOCODE = Workflow([("geocode", _geocode)])


def _offsets(t: Tables, o: dict) -> DataFrame:
    return kernels.match2d(t["chips"], o["height"], o["width"], o["search"])


def _culled(t: Tables, o: dict) -> DataFrame:
    return t["match"].where((F.col("correlation") >= o.get("correlation", 0.3)) & (F.col("snr") >= o.get("snr", 4.0)))


#: Chips and windows to offsets that stand.
OFFSETS = Workflow([("match", _offsets), ("cull", _culled)])

WORKFLOWS = {"insar": INTERFEROMETRY, "covariance": COVARIANCE, "focus": FOCUS, "geocode": GEOCODE, "offsets": OFFSETS}


def main(argv: list[str] | None = None) -> None:
    """Runs a workflow: name, folder of input tables (Parquet), output folder, and a file of options."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("workflow", choices=sorted(WORKFLOWS))
    p.add_argument("tables", help="folder with one Parquet table for each input")
    p.add_argument("output")
    p.add_argument("--inputs", nargs="+", required=True)
    p.add_argument("--options", help="file of 'name: value' lines")
    p.add_argument("--restart", action="store_true", help="begin anew, whatever is there")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    options = formats.plain_yaml("\n".join(r["value"] for r in spark.read.text(a.options).collect())) if a.options else {}
    WORKFLOWS[a.workflow].run(spark, {n: spark.read.parquet(f"{a.tables}/{n}") for n in a.inputs}, a.output, options, a.restart)


if __name__ == "__main__":
    main()
