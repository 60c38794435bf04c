"""Every raster query against its SQL in DuckDB, and kernels against closed forms."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from rasterloom.catalog import oracle_sql, queries
from rasterloom.functions import geometry, scalar
from rasterloom.operators import aggregates, imaging, kernels, pixelwise

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda x: None if x is None else f"{x + 0.0:.5f}" if isinstance(x, float) else str(x)
    return sorted(tuple(str(tidy(r[i])) for i in at) for r in rows)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    want = duck.execute(oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(df.columns) == sorted(names)
    got, want = plain(df.collect(), df.columns), plain(want.fetchall(), names)
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    near = all(x == y or abs(float(x) - float(y)) <= 2e-5 for a, b in wrong for x, y in zip(a, b, strict=True))
    assert near, wrong[:3]


def test_weightless_window_is_nan(spark):
    rows = [(i, j, float(i * j), 0.0 if i < 3 and j < 3 else 1.0) for i in range(6) for j in range(6)]
    got = aggregates.multilook_weighted(spark.createDataFrame(rows, "line long, pixel long, value double, weight double"), 3, 3).collect()
    assert sum(math.isnan(x["mean"]) for x in got) == 1 and len(got) == 4


def test_partial_windows_are_dropped(spark):
    rows = [(i, j, float(i * j)) for i in range(21) for j in range(20)]
    got = aggregates.multilook(spark.createDataFrame(rows, "line long, pixel long, value double"), 3, 3)
    assert got.count() == 7 * 6


def test_same_image_has_coherence_one(spark):
    rows = [(i, j, math.cos(i * j), math.sin(i * j)) for i in range(12) for j in range(12)]
    x = spark.createDataFrame(rows, "line long, pixel long, re double, im double")
    for r in aggregates.multilook_interferogram(pixelwise.pair(x, x), 3, 3).collect():
        assert abs(r["phase"]) < 1e-9 and abs(r["coherence"] - 1) < 1e-9


def test_single_sample_has_deviation_zero(spark):
    assert aggregates.real_stats(spark.createDataFrame([(0, 0, 5.0)], "line long, pixel long, value double")).first()["deviation"] == 0.0


def test_clip_of_zero_is_nan(spark):
    got = pixelwise.clip_magnitude(spark.createDataFrame([(0, 0, 0.0, 0.0)], "line long, pixel long, re double, im double"), 1.0, 2.0).first()
    assert math.isnan(got["re"])


def test_match_finds_a_shift(spark):
    x = np.random.default_rng(0).standard_normal(200)
    df = spark.createDataFrame([(1, x[10:110].tolist(), x[7:107].tolist())], "line long, a array<double>, b array<double>")
    got = kernels.match(df, 8).first()
    assert abs(got["offset"] - 3) < 0.3 and got["correlation"] > 0.99


def test_bessel(spark):
    got = spark.range(1).select(scalar.bessel_i0(scalar.F.lit(2.5)).alias("x")).first()["x"]
    assert abs(got - np.i0(2.5)) < 1e-12


def test_range_equations_close():
    """A target found from time, range and height lies where it came from when it is turned back."""
    t, slant, height = np.linspace(0, 900, 40), np.full(40, 850_000.0), np.linspace(-100, 4000, 40)
    for right in (True, False):
        xyz = geometry.rdr2geo(t, slant, height, right, 7.1e6, 1.05e-3)
        back, far = geometry.geo2rdr(xyz, 7.1e6, 1.05e-3)
        assert np.abs(back - t).max() < 2e-6 and np.abs(far - slant).max() < 1e-3


def test_shift_by_part_of_a_sample(spark):
    n = 64
    wave = lambda s: [math.cos(2 * math.pi * 5 * (i - s) / n) for i in range(n)]
    df = spark.createDataFrame([(0, wave(0)), (1, [])], "line long, values array<double>")
    got = {r["line"]: r["values"] for r in kernels.shifted(df, 0.25).collect()}
    assert np.allclose(got[0], wave(0.25)) and got[1] == []
    up = {r["line"]: r["values"] for r in kernels.upsampled(df, 4).collect()}
    assert np.allclose(up[0], [math.cos(2 * math.pi * 5 * i / (4 * n)) for i in range(4 * n)])


def test_eigen_interference_takes_a_tone_out(spark):
    rng = np.random.default_rng(1)
    z = rng.standard_normal((16, 80)) + 1j * rng.standard_normal((16, 80))
    tone = 30 * np.outer(np.exp(2j * np.pi * 0.2 * np.arange(16)), np.ones(80))
    rows = [(i, j, float((z + tone)[i, j].real), float((z + tone)[i, j].imag)) for i in range(16) for j in range(80)]
    got = imaging.eigen_interference(spark.createDataFrame(rows, "line long, pixel long, re double, im double"), 16, 8.0).first()
    assert got["removed"] == 1 and got["power"] < 3


def test_scatter_keeps_the_area(spark):
    rows = [(i * 0.37, i * 0.51, float(i)) for i in range(30)]
    got = imaging.scatter(spark.createDataFrame(rows, "y double, x double, area double")).agg({"area": "sum"}).first()[0]
    assert abs(got - sum(r[2] for r in rows)) < 1e-9


def test_projection_of_the_pole_and_the_meridian(spark):
    x, y = geometry.polar_stereographic(geometry.F.lit(0.3), geometry.F.lit(math.pi / 2), 0.0, math.radians(70))
    e, n = geometry.transverse_mercator(geometry.F.lit(0.1), geometry.F.lit(0.0), 0.1)
    got = spark.range(1).select(x.alias("x"), y.alias("y"), e.alias("e"), n.alias("n")).first()
    assert abs(got["x"]) < 1e-6 and abs(got["y"]) < 1e-6 and abs(got["e"] - 500_000) < 1e-6 and abs(got["n"]) < 1e-6
