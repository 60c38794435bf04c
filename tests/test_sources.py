"""Readers and writers on small files, and rules of product folders."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.sources import formats, rasters

HEADER = "ENVI\ndescription = {\n  a test}\nsamples = 5\nlines = 4\nbands = 2\ndata type = {t}\ninterleave = {i}\nbyte order = {b}\n"


@pytest.mark.parametrize(("interleave", "order"), [("bsq", 0), ("bil", 1), ("bip", 0)])
def test_flat_raster(spark, tmp_path, interleave, order):
    x = np.arange(40, dtype=">f4" if order else "<f4").reshape(2, 4, 5)
    laid = {"bsq": x, "bil": x.transpose(1, 0, 2), "bip": x.transpose(1, 2, 0)}[interleave]
    (tmp_path / "r").write_bytes(np.ascontiguousarray(laid).tobytes())
    (tmp_path / "r.hdr").write_text(HEADER.replace("{t}", "4").replace("{i}", interleave).replace("{b}", str(order)))
    got = {(r["band"], r["line"]): r["values"] for r in formats.flat_raster(spark, str(tmp_path / "r")).collect()}
    assert got == {(b, i): x[b, i].tolist() for b in range(2) for i in range(4)}


def test_flat_complex_and_back(spark, tmp_path):
    z = (np.arange(12) + 1j * np.arange(12)[::-1]).astype("<c8").reshape(3, 4)
    (tmp_path / "z").write_bytes(z.tobytes())
    (tmp_path / "z.hdr").write_text("ENVI\nsamples = 4\nlines = 3\nbands = 1\ndata type = 6\n")
    rows = formats.flat_raster(spark, str(tmp_path / "z")).orderBy("line").collect()
    assert [r["im"] for r in rows] == z.imag.tolist()
    df = spark.createDataFrame([(i, [float(i), i + 0.5]) for i in range(7)], "line long, values array<double>").repartition(3)
    formats.write_flat(df, str(tmp_path / "out"))
    back = {r["line"]: r["values"] for r in formats.flat_raster(spark, str(tmp_path / "out")).collect()}
    assert back == {i: [float(i), i + 0.5] for i in range(7)}


def test_orbit_and_attitude(spark, tmp_path):
    osv = "".join(f"<OSV><TAI>TAI=2020-01-01T00:00:{i:02d}</TAI><UTC>UTC=2020-01-01T00:00:{i:02d}.500000</UTC><X unit='m'>{i}.5</X><Y unit='m'>2</Y><Z unit='m'>3</Z><VX>4</VX><VY>5</VY><VZ>6</VZ><Quality>NOMINAL</Quality></OSV>" for i in range(3))
    (tmp_path / "o.xml").write_text(f"<Earth_Explorer_File><Data_Block><List_of_OSVs count='3'>{osv}</List_of_OSVs></Data_Block></Earth_Explorer_File>")
    got = formats.orbit_xml(spark, str(tmp_path / "o.xml")).orderBy("t").collect()
    assert [r["t"] for r in got] == [0.0, 1.0, 2.0] and got[2]["x"] == 2.5 and got[0]["quality"] == "NOMINAL"
    qst = "<QST><utc>2020-01-01T00:00:00.0</utc><roll>90</roll><pitch>0</pitch><yaw>-45</yaw><q0>1</q0><q1>0</q1><q2>0</q2><q3>0</q3><qualityFlag>OK</qualityFlag></QST>"
    (tmp_path / "a.xml").write_text(f"<att>{qst}</att>")
    one = formats.attitude_xml(spark, str(tmp_path / "a.xml")).first()
    assert abs(one["roll"] - np.pi / 2) < 1e-12 and one["q0"] == 1


def test_electron_content(spark, tmp_path):
    told = {"utc": ["2020-01-01T00:00:00", "2020-01-01T00:01:00"], "totTecNr": [10.0, 11.0], "topTecNr": [3.0, 3.5], "totTecFr": [9.0, 9.0], "topTecFr": [2.0, 1.0]}
    (tmp_path / "t.json").write_text(json.dumps(told, indent=1))
    got = formats.electron_content(spark, str(tmp_path / "t.json")).orderBy("utc").collect()
    assert [(r["near"], r["far"]) for r in got] == [(7.0, 7.0), (7.5, 8.0)]


def test_calibration():
    text = "# made up\nvalid_after_date: 2020-01-01\nreference_bw: 20\n20MHz:\n  hh:\n    scale: 1.5\n    delay: -0.25  # metres\n  on: true\nlist: [1, 2.5, x]\n"
    got = formats.calibration(text, 20)
    assert got["hh"] == {"scale": 1.5, "delay": -0.25} and got["reference_bw"] == 20 and got["list"] == [1, 2.5, "x"] and got["on"] is True


def test_records(spark, tmp_path):
    data = b"".join(struct.pack(">if", i, i / 2) + f"{i * 3:8d}".encode() for i in range(5))
    (tmp_path / "r.bin").write_bytes(data)
    got = formats.records(spark, str(tmp_path / "r.bin"), 16, [("a", 0, ">i"), ("b", 4, ">f"), ("c", 8, "A8")]).orderBy("number").collect()
    assert [(r["a"], r["b"], r["c"]) for r in got] == [(i, i / 2, i * 3.0) for i in range(5)]


def test_products(spark, tmp_path):
    lines = spark.createDataFrame([(0, "A", [1.0], [2.0]), (1, "B", [3.0], [4.0])], "line long, frequency string, re array<double>, im array<double>")
    orbit = spark.createDataFrame([(0.0, 1.0)], "t double, x double")
    formats.write_product({"lines": lines, "orbit": orbit}, str(tmp_path / "p"), "slc", {"mission": "x"})
    got = formats.open_product(spark, str(tmp_path / "p"))
    assert set(got) == {"lines", "orbit"} and got["lines"].where("frequency = 'B'").first()["re"] == [3.0]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "product.json").write_text('{"type": "other"}')
    with pytest.raises(ValueError, match="other"):
        formats.open_product(spark, str(tmp_path / "q"))


def test_metadata_and_tiles(spark):
    t = spark.createDataFrame([("/a/b", "1"), ("/a/bc", "2"), ("/a/b/c", "3"), ("/d/RSLC", "4")], "name string, value string")
    got = formats.copied_metadata(t, ["/a/b"], {"RSLC": "GSLC"}).collect()
    assert sorted((r["name"], r["value"]) for r in got) == [("/a/bc", "2"), ("/d/GSLC", "4")]
    assert formats.found(t, r"/b[^/]*$", "/a").count() == 2
    c = spark.createDataFrame([(f"t{i}", i * 60.0 - 180, -30.0, i * 60.0 - 120, 30.0) for i in range(6)], "tile string, west double, south double, east double, north double")
    assert sorted(r["tile"] for r in formats.tiles_within(c, 170.0, 0.0, -170.0, 10.0).collect()) == ["t0", "t5"]
    assert [r["tile"] for r in formats.tiles_within(c, 1.0, 0.0, 2.0, 10.0).collect()] == ["t3"]
    assert formats.updated({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}, "d": {"e": 1}}) == {"a": {"b": 5, "c": 2}, "d": {"e": 1}}


def test_reflectors(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Corner reflector ID,lat,lon,h,az,el,side\n N01 , 45.0,-90.0,10,180,-10,2.4\n# end\n")
    got = rasters.corner_reflectors(spark, str(tmp_path / "c.csv")).collect()
    assert len(got) == 1 and got[0]["id"] == "N01" and abs(got[0]["latitude"] - np.pi / 4) < 1e-12 and got[0]["velocity_up"] == 0.0


def test_written_bands_are_read_alone(spark, tmp_path):
    x = spark.range(10).select(F.col("id").alias("line"), F.lit(0).alias("pixel"), (F.col("id") % 2).cast("string").alias("band"), F.lit(1.0).alias("value"))
    rasters.write_bands(x, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).where("band = '1'").count() == 5


def test_stream_of_events(spark, tmp_path):
    from rasterloom.streaming import lines

    src = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(src)
    stream = lines.windowed_stats(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    want = spark.read.parquet(src).where("value is not null").count()
    assert spark.table("seen").agg(F.sum("n")).first()[0] == want
