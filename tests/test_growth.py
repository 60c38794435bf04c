"""Joins and kernels whose cost must not grow faster than what they give: same rows however a key is dealt, no task with all of it."""

import math

import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators import antenna, joins, kernels, lookups
from rasterloom.plans import raster


def test_rounding_is_that_of_round(spark):
    rng = np.random.default_rng(0)
    halves = [s * (k + d) / 1e6 for s in (1, -1) for k in (0, 1, 7, 499999, 123456789) for d in (0, 0.5, 0.5 - 1e-9, 0.5 + 1e-9, 0.4991, 0.4989)]
    odd = [0.0, -0.0, 1e-300, 1e5 + 0.1234565, 1e7 / 3, 1e12 / 7, 1e19, -1e300, math.inf, -math.inf, math.nan, None]
    x = spark.createDataFrame([(v,) for v in [*rng.normal(0, 3, 3000).tolist(), *rng.normal(0, 1e6, 3000).tolist(), *halves, *odd]], "v double")
    for digits in (0, 3, 4, 6):
        got = x.select((raster.near("v", digits) + 0.0).alias("a"), (F.round("v", digits) + 0.0).alias("b"))
        assert got.where("not a <=> b").count() == 0


def test_bands_of_one_bin_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(joins, "PART", 64, raising=False)
    rng = np.random.default_rng(1)
    rows = [("HH", i, float(a), float(a + b)) for i, (a, b) in enumerate(zip(rng.integers(0, 90, 600), rng.integers(1, 30, 600), strict=True))]
    left, right = (spark.createDataFrame(x, "pol string, name long, lo double, hi double").coalesce(1) for x in (rows[:300], rows[300:]))
    got = joins.band_overlaps(left, right).withColumn("task", F.spark_partition_id()).collect()
    want = sorted((n, m, max(a, c), min(b, d)) for _, n, a, b in rows[:300] for _, m, c, d in rows[300:] if a < d and c < b)
    assert sorted((r["name"], r["name2"], r["lo"], r["hi"]) for r in got) == want
    assert len({r["task"] for r in got}) > 1


def runs(df, columns):
    """How often the values of columns change from one row to the next of a task."""
    rows = df.withColumn("task", F.spark_partition_id()).collect()
    return sum(r["task"] != s["task"] or any(r[c] != s[c] for c in columns) for r, s in zip(rows, rows[1:], strict=False)) + 1, len({r["task"] for r in rows})


def test_gaps_of_one_time_come_together(spark, monkeypatch):
    monkeypatch.setattr(joins, "PART", 64, raising=False)
    times = [(k * 37 % 50) * 0.5 for k in range(400)]
    pulses = spark.createDataFrame(list(enumerate(times)), "pulse long, t double").coalesce(1)
    got = joins.gap_mask(pulses, 2.0, 9.0, 0.5)
    want = sorted((i, b - 0.5 - a, b + 0.5 - a) for i, a in enumerate(times) for b in times if b > a and a + 1.5 <= b <= a + 9.5)
    assert sorted((r["pulse"], r["begin"], r["end"]) for r in got.collect()) == want
    changes, tasks = runs(got, ["pulse", "begin"])
    assert tasks > 1 and changes < len(want) / 2


def test_overlaps_of_equal_blocks_come_in_order(spark, monkeypatch):
    monkeypatch.setattr(joins, "PART", 64, raising=False)
    blocks = [(i, float(i * 7 % 40), float(i * 7 % 40 + 20)) for i in range(300)]
    spans = [(i, float(i * 11 % 60), float(i * 11 % 60 + 15)) for i in range(300)]
    b = spark.createDataFrame(blocks, "block long, b0 double, b1 double").coalesce(1)
    got = lookups.block_overlaps(b, spark.createDataFrame(spans, "span long, s0 double, s1 double").coalesce(1), 200.0)
    want = sorted((i, j) for i, b0, b1 in blocks for j, s0, s1 in spans if b0 <= s1 and s0 <= b1)
    assert sorted((r["block"], r["span"]) for r in got.collect()) == want
    changes, tasks = runs(got, ["block"])
    assert tasks > 1 and changes < len(want) / 10
    start, rows = {i: s0 for i, s0, _ in spans}, got.collect()
    falls = sum(r["block"] == s["block"] and start[r["span"]] > start[s["span"]] for r, s in zip(rows, rows[1:], strict=False))
    assert falls < len(want) / 20


def test_clipping_is_written_out_once(spark):
    """Each of four sides had the polygon before it some five times: the expression grew as their product."""
    df = spark.createDataFrame([(1, [(-5.0, -4.0), (1.0, -4.0), (1.0, 1.0), (-5.0, 1.0)]), (2, []), (3, None), (4, [(2.0, 2.0), (12.0, 2.0), (2.0, 12.0)])], "id long, p array<struct<x:double,y:double>>")
    got = df.select("id", antenna.polygon_area(antenna.clipped(F.col("p"), (0.0, 0.0, 10.0, 8.0))).alias("a"))
    # the triangle under x + y = 14 without its tips over x = 10 and y = 8
    assert {r["id"]: r["a"] for r in got.collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 50.0 - 2.0 - 8.0}
    assert len(got._jdf.queryExecution().analyzed().toString()) < 20_000


def test_lookups_do_not_send_probes_through_the_driver(spark, monkeypatch):
    """The probes look small to the planner, as their taps are not counted."""
    grid = spark.range(8 * 9).select(F.floor(F.col("id") / 9).alias("iy"), (F.col("id") % 9).alias("ix"), (F.floor(F.col("id") / 9) * 10.0 + F.col("id") % 9).alias("v"))
    probes = spark.createDataFrame([(i, 1.0 + i % 5, 1.0 + i % 6) for i in range(20)], "probe long, y double, x double").where("probe < 3")
    for kind, lookup in joins.INTERPOLATORS.items():
        monkeypatch.setattr(joins, "HELD", 72, raising=False)
        got = lookup(probes, grid, 8, 9)
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert "BuildRight" in plan and "BuildLeft" not in plan, kind
        assert {r["probe"]: round(r["value"], 9) for r in got.collect()} == {0: 11.0, 1: 22.0, 2: 33.0}
        monkeypatch.setattr(joins, "HELD", 71)
        got = lookup(probes, grid, 8, 9)
        assert "SortMergeJoin" in got._jdf.queryExecution().sparkPlan().toString(), kind
        assert {r["probe"]: round(r["value"], 9) for r in got.collect()} == {0: 11.0, 1: 22.0, 2: 33.0}


def test_point_target_is_upsampled_once_and_by_directions(monkeypatch):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(6, 8)) + 1j * rng.normal(size=(6, 8))
    f, g = np.fft.fftfreq(6, 1 / 6), np.fft.fftfreq(8, 1 / 8)
    y, x = np.arange(24) / 4, np.arange(32) / 4
    want = np.exp(2j * np.pi * np.outer(y, f) / 6) @ np.fft.fft2(z) @ np.exp(2j * np.pi * np.outer(g, x) / 8) / 48
    monkeypatch.setattr(np.fft, "ifft2", None)
    got = kernels.point_target(z, 4)
    i, j = np.unravel_index((np.abs(want) ** 2).argmax(), want.shape)
    assert (got["y"], got["x"]) == (i / 4, j / 4) and abs(got["peak"] - abs(want[i, j]) ** 2) < 1e-9 and abs(got["phase"] - np.angle(want[i, j])) < 1e-9


def test_windows_are_those_of_all_gaps_without_a_join_of_pulses(spark):
    rng = np.random.default_rng(4)
    times = [*np.round(rng.uniform(-300, 3000, 150), 2).tolist(), 0.0, 60.0, 60.0, 135.0, 670.0, 5000.0]
    n, want = 60, []
    for i, t in enumerate(times):
        gaps = [(lookups.whole(np.array((s - t - 65.0) * 0.1)), lookups.whole(np.array((s + 25.0 - t - 60.0) * 0.1))) for s in times if t <= s and s - 5.0 <= t + 660.0]
        free = [0, *(int(not any(a <= k < b for a, b in gaps)) for k in range(n)), 0]
        want += zip([i] * n, [k for k in range(n) if free[k] < free[k + 1]], [k for k in range(n + 1) if free[k] > free[k + 1]], strict=False)
    pulses = spark.createDataFrame([*enumerate(times), (999, None)], "pulse long, t double")
    got = lookups.receivable(pulses, 60.0, 0.1, n, 20.0, 5.0)
    assert sorted(map(tuple, got.collect())) == sorted([*want, (999, 0, n)])
    assert "sent" not in got._jdf.queryExecution().optimizedPlan().toString()
