"""Kernels, geometry and unwrapping against closed forms and plain NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import frames, generators, orbits
from rasterloom.operators import geometry, imaging, kernels, unwrap
from rasterloom.operators import estimators as E


def circle(n=91, radius=7.1e6, rate=0.00105):
    a = np.arange(n) * 10 * rate
    zero = np.zeros(n)
    return np.stack([np.arange(n) * 10.0, radius * np.cos(a), zero, radius * np.sin(a), -radius * rate * np.sin(a), zero, radius * rate * np.cos(a)], 1)


@pytest.mark.parametrize("method", ["hermite", "legendre"])
def test_orbit_interpolation(method):
    orbit = orbits.Orbit(circle(), method)
    t = np.concatenate([np.linspace(0, 900, 777), np.arange(0, 901, 10.0)])
    p, v = orbit(t)
    want = 7.1e6 * np.stack([np.cos(0.00105 * t), 0 * t, np.sin(0.00105 * t)], 1)
    assert np.abs(p - want).max() < 1e-6
    assert np.abs(v - 0.00105 * 7.1e6 * np.stack([-np.sin(0.00105 * t), 0 * t, np.cos(0.00105 * t)], 1)).max() < 1e-6
    assert np.isnan(orbit(np.array([-1.0, 901.0]))[0]).all()


@pytest.mark.parametrize("right", [True, False])
@pytest.mark.parametrize("fd", [0.0, 300.0])
def test_ground_and_back(right, fd):
    orbit = orbits.Orbit(circle())
    doppler = lambda t, r: fd + 1e-4 * (r - 8e5)
    t, r = np.linspace(50, 850, 60), np.linspace(7.6e5, 9e5, 60)
    surface = lambda lon, lat: 300 + 2000 * np.abs(lat)
    lon, lat, h = orbits.rdr2geo(t, r, orbit, 0.24, surface, doppler, right)
    assert np.abs(h - surface(lon, lat)).max() < 1e-3
    t2, r2 = orbits.geo2rdr(orbits.to_xyz(lon, lat, h), orbit, 0.24, doppler, right)
    assert np.abs(t2 - t).max() < 2e-6 and np.abs(r2 - r).max() < 1e-3
    assert np.isnan(orbits.geo2rdr(orbits.to_xyz(lon, lat, h), orbit, 0.24, doppler, not right)[0]).all()


def test_resampling_by_parts_of_a_sample(spark):
    n, m = 80, 64
    y, x = np.meshgrid(np.arange(n), np.arange(m), indexing="ij")
    wave = lambda y, x: np.exp(2j * np.pi * (0.07 * y + 0.11 * x))
    z = wave(y, x)
    rows = [(int(i), z[i].real.tolist(), z[i].imag.tolist()) for i in range(n)]
    got = kernels.resampled(spark.createDataFrame(rows, "line long, re array<double>, im array<double>"), lambda i, j: 0.3 + 0.001 * j, lambda i, j: -0.4 + 0 * i, 4, 32).collect()
    assert len(got) == n
    for r in got:
        if 6 <= r["line"] < n - 6:
            want = wave(r["line"] + 0.3 + 0.001 * np.arange(m), np.arange(m) - 0.4)[6:-6]
            assert np.abs(np.array(r["re"]) + 1j * np.array(r["im"]) - np.pad(want, 6, constant_values=np.nan))[6:-6].max() < 0.02


def test_correlation_surface_is_plain_correlation():
    rng = np.random.default_rng(0)
    w, c = rng.standard_normal((12, 13)), rng.standard_normal((5, 6))
    got = kernels.correlation_surface(c, w)
    for i in range(8):
        for j in range(8):
            assert abs(got[i, j] - np.corrcoef(c.ravel(), w[i : i + 5, j : j + 6].ravel())[0, 1]) < 1e-9


@pytest.mark.parametrize("mode", ["full", "valid", "same"])
def test_compression_modes(spark, mode):
    rng = np.random.default_rng(1)
    x, r = rng.standard_normal(40), rng.standard_normal(7) + 1j * rng.standard_normal(7)
    got = kernels.compressed(spark.createDataFrame([(0, x.tolist()), (1, x[:10].tolist()), (2, [])], "line long, values array<double>"), r, mode).collect()
    for row, v in zip(sorted(got, key=lambda g: g["line"]), (x, x[:10], x[:0]), strict=True):
        want = np.correlate(v, r, mode) if len(v) >= 7 else np.empty(0)
        if mode == "same" and len(v) >= 7:
            want = np.correlate(v, r, "full")[3 : 3 + len(v)]
        assert np.allclose(np.array(row["re"]) + 1j * np.array(row["im"]), want)


def test_notch_takes_a_tone_out(spark):
    rng = np.random.default_rng(2)
    z = rng.standard_normal((64, 128)) + 1j * rng.standard_normal((64, 128)) + 40 * np.exp(2j * np.pi * 20 / 128 * np.arange(128))
    rows = [(i, z[i].real.tolist(), z[i].imag.tolist()) for i in range(64)]
    got = kernels.notch(spark.createDataFrame(rows, "line long, re array<double>, im array<double>"), 20.0).collect()
    power = np.mean([np.array(r["re"]) ** 2 + np.array(r["im"]) ** 2 for r in got])
    assert len(got) == 64 and power < 2.2


def test_point_target():
    n = 32
    f = np.fft.fftfreq(n)
    w = (np.abs(f) <= 0.25) * np.exp(-2j * np.pi * f * 15.25)
    got = kernels.point_target(np.fft.ifft2(np.outer(w, w)) * n)
    assert abs(got["y"] - 15.25) < 0.07 and abs(got["x"] - 15.25) < 0.07
    assert abs(got["y_width"] - 0.886 * n / 17) < 0.1 and abs(got["y_pslr"] + 13.3) < 0.7


def cone(n, m):
    y, x = np.meshgrid(np.arange(n) - n / 2, np.arange(m) - m / 2, indexing="ij")
    return 0.8 * np.hypot(y, x)


def test_unwrapping_a_cone(spark):
    truth = cone(60, 50)
    phase = np.angle(np.exp(1j * truth))
    out, label = unwrap.unwrap_tile(phase)
    assert label.min() == 1 and label.max() == 1
    assert np.abs(out - out[0, 0] - (truth - truth[0, 0])).max() < 1e-6
    df = spark.createDataFrame([(i, phase[i].tolist()) for i in range(60)], "line long, values array<double>")
    got = {(r["line"], r["pixel"]): r["value"] for r in unwrap.unwrapped(df, 16).collect()}
    flat = np.array([[got[i, j] for j in range(50)] for i in range(60)])
    assert np.abs(flat - flat[0, 0] - (truth - truth[0, 0])).max() < 1e-6


def test_unwrapping_round_two_residues():
    """Off a cut between two opposite residues the phase is congruent and steps stay below half a turn."""
    y, x = np.meshgrid(np.arange(40.0), np.arange(40.0), indexing="ij")
    phase = np.angle(np.exp(1j * (np.arctan2(y - 19.5, x - 10.5) - np.arctan2(y - 19.5, x - 28.5))))
    charge = unwrap.residues(phase)
    assert sorted(charge[charge != 0].tolist()) == [-1, 1]
    cut = unwrap.branch_cuts(charge, phase.shape)
    out, label = unwrap.unwrap_tile(phase)
    assert 10 < cut.sum() < 60 and label.max() == 1
    some = ~np.isnan(out)
    assert np.abs((out - phase)[some] / (2 * np.pi) - np.rint((out - phase)[some] / (2 * np.pi))).max() < 1e-5
    free = ~cut[:, 1:] & ~cut[:, :-1]
    assert np.abs(np.diff(out, axis=1))[free].max() < np.pi + 1e-9


def test_geocoding_a_tone(spark):
    """An image that is one phase ramp in line and pixel is that ramp, and the range phase, at map places."""
    orbit = orbits.Orbit(circle())
    start, prf, near, spacing = 100.0, 2.0, 8.0e5, 200.0
    lines = [(i, *(f(2 * np.pi * (0.05 * i + 0.08 * np.arange(80))).tolist() for f in (np.cos, np.sin))) for i in range(60)]
    image = spark.createDataFrame(lines, "line long, re array<double>, im array<double>")
    t, r = np.meshgrid(start + np.arange(10, 50, 3.3) / prf, near + np.arange(10, 70, 7.7) * spacing, indexing="ij")
    lon, lat, _ = orbits.rdr2geo(t.ravel(), r.ravel(), orbit, 0.24)
    places = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat, strict=True))], "id long, lon double, lat double")
    got = {x["id"]: x["re"] + 1j * x["im"] for x in geometry.geocoded_slc(image, places, orbit, 0.24, start, prf, near, spacing, block=16).collect()}
    assert len(got) == t.size
    y, x = (t.ravel() - start) * prf, (r.ravel() - near) / spacing
    want = np.exp(2j * np.pi * (0.05 * y + 0.08 * x)) * np.exp(4j * np.pi / 0.24 * r.ravel())
    assert max(abs(abs(got[i]) - 1) for i in got) < 0.02
    assert max(abs(np.angle(got[i] / want[i])) for i in got) < 0.05


def test_eigen_interference_is_numpys(spark):
    rng = np.random.default_rng(3)
    z = rng.standard_normal((32, 20)) + 1j * rng.standard_normal((32, 20))
    rows = [(i, j, float(z[i, j].real), float(z[i, j].imag)) for i in range(32) for j in range(20)]
    df = spark.createDataFrame(rows, "line long, pixel long, re double, im double")
    for r in imaging.eigen_interference(df, 8, 3.0).collect():
        b = z[r["block"] * 8 : r["block"] * 8 + 8]
        w = np.linalg.eigvalsh(b @ b.conj().T / 20)
        assert abs(r["largest"] - w[-1]) < 1e-9 and r["removed"] == int((w > 3 * np.median(w)).sum())
    got = E.noise_by_eigenvalue(df, 8).first()
    least = [np.linalg.eigvalsh(z[k : k + 8] @ z[k : k + 8].conj().T / 20)[0] for k in range(0, 32, 8)]
    assert abs(got["noise"] - np.median(least)) < 1e-9 and got["blocks"] == 4


def test_kernels_and_numbers():
    assert [generators.next_fast(n) for n in (1, 7, 11, 13, 17, 121, 1000, 1021)] == [1, 8, 12, 15, 18, 125, 1000, 1024]
    assert abs(sum(generators.gaussian(9, 2.0)) - 1) < 1e-12 and generators.delta(5)[2] == 1
    assert abs(E.normal_quantile(0.975) - 1.959963984540054) < 1e-12


def test_chirp_and_windows(spark):
    c = generators.chirp(spark, 1e3, 0.1, 1000.0).collect()
    assert len(c) == 100 and abs(c[0]["re"] - c[99]["re"]) < 1e-12
    k = generators.KERNELS["knab"](8.0, 0.8)
    got = spark.range(1).select(k(F.lit(0.0)).alias("a"), k(F.lit(1.0)).alias("b"), k(F.lit(5.0)).alias("c")).first()
    assert abs(got["a"] - 1) < 1e-12 and abs(got["b"]) < 1e-12 and got["c"] == 0


def test_a_projection_that_is_not_known():
    with pytest.raises(ValueError, match="27700"):
        frames.projection(27700)
    assert math.isclose(frames.Peg(0.0, 0.0, 0.0).radius, 6378137.0 * (1 - 0.0066943799901), rel_tol=1e-9)


def test_a_workflow_goes_on_where_it_stopped(spark, tmp_path):
    from rasterloom.workflows import Workflow

    ran = []

    def step(name):
        def run(tables, options):
            ran.append(name)
            if name == "b" and options.get("fail"):
                raise RuntimeError("stopped")
            return tables["in"].withColumn("x", F.col("x") + len(name))

        return name, run

    flow = Workflow([step("a"), step("b"), step("c")])
    start = {"in": spark.createDataFrame([(1,)], "x long")}
    with pytest.raises(RuntimeError):
        flow.run(spark, start, str(tmp_path / "w"), {"fail": True})
    assert flow.done(spark, str(tmp_path / "w")) == ["a"]
    got = flow.run(spark, start, str(tmp_path / "w"))
    assert ran == ["a", "b", "b", "c"] and got["c"].first()["x"] == 2
    flow.run(spark, start, str(tmp_path / "w"), restart=True)
    assert ran[-3:] == ["a", "b", "c"]


def test_command_line(spark, tmp_path):
    from rasterloom import workflows

    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(48).tolist()) for i in range(24)]
    for n in ("reference", "secondary"):
        spark.createDataFrame(rows, "line long, values array<double>").write.parquet(str(tmp_path / n))
    (tmp_path / "o.yaml").write_text("lines: 2\npixels: 2\ncoherence: 0.5\n")
    workflows.main(["insar", str(tmp_path), str(tmp_path / "out"), "--inputs", "reference", "secondary", "--options", str(tmp_path / "o.yaml")])
    got = spark.read.parquet(str(tmp_path / "out" / "unwrap")).agg(F.max(F.abs("value")), F.count("*")).first()
    assert got[0] < 1e-9 and got[1] == 144
