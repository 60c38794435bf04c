"""File formats: flat rasters with a text header, state vectors in XML, electron content in JSON, calibration in YAML, record files, product folders.

Readers go through Spark's own readers, so any store that Spark reaches will do; binary files
are cut into lines inside the tasks that read them.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Data type codes of flat raster headers.
TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 6: "c8", 9: "c16", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}


def header(text: str) -> dict[str, str]:
    """The fields of a flat raster's header; values in braces may go over several lines."""
    out: dict[str, str] = {}
    name, value = "", ""
    for line in text.splitlines():
        if name:
            value += " " + line.strip()
        elif "=" in line:
            name, value = (x.strip() for x in line.split("=", 1))
        else:
            continue
        if value.count("{") == value.count("}"):
            out[name.lower()] = value
            name = ""
    return out


def flat_raster(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a flat raster (band, line, values; re and im for complex types) with its header at path + '.hdr'.

    The header tells shape, type, byte order and interleave. The data is read as fixed-length
    records of one line each, so Spark splits a file of any size between tasks.
    """
    text = "\n".join(r["value"] for r in spark.read.text(f"{path}.hdr").collect())
    h = header(text)
    width, bands, lines = int(h["samples"]), int(h.get("bands", 1)), int(h["lines"])
    kind = np.dtype((">" if h.get("byte order", "0") == "1" else "<") + TYPES[int(h["data type"])])
    order = h.get("interleave", "bsq").lower()
    per = width * kind.itemsize * (bands if order in ("bil", "bip") else 1)
    records = spark.sparkContext.binaryRecords(path, per).zipWithIndex().map(lambda x: (x[1], bytearray(x[0]))).toDF("number long, data binary")
    complex_ = kind.kind == "c"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for number, data in zip(pdf["number"], pdf["data"], strict=True):
                v = np.frombuffer(data, kind)
                if order == "bsq":
                    parts = [(number // lines, number % lines, v)]
                elif order == "bil":
                    parts = [(b, number, v[b * width : (b + 1) * width]) for b in range(bands)]
                else:
                    parts = [(b, number, v[b::bands]) for b in range(bands)]
                for b, i, x in parts:
                    rows.append((b, i, x.real.astype(float), x.imag.astype(float)) if complex_ else (b, i, x.astype(float)))
            yield pd.DataFrame(rows, columns=["band", "line", *(["re", "im"] if complex_ else ["values"])])

    shape = "band long, line long, " + ("re array<double>, im array<double>" if complex_ else "values array<double>")
    return records.mapInPandas(run, shape)


def write_flat(lines: DataFrame, path: str, kind: str = "f4") -> None:
    """Writes lines (line, values) as one flat raster a partition of ordered lines, and a header for each: parts of one image, in order."""
    spark = lines.sparkSession
    dtype = np.dtype("<" + kind)
    code = next(k for k, v in TYPES.items() if v == kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"line": pdf["line"], "data": [np.asarray(v, dtype).tobytes() for v in pdf["values"]], "n": [len(v) for v in pdf["values"]]})

    packed = lines.repartitionByRange("line").sortWithinPartitions("line").mapInPandas(run, "line long, data binary, n long")
    store = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    count = width = 0
    try:  # one line at a time comes through the driver, as a single file has one writer
        for row in packed.orderBy("line").toLocalIterator():
            out.write(bytearray(row["data"]))
            count, width = count + 1, row["n"]
    finally:
        out.close()
    head = store.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.hdr"), True)
    head.write(bytearray(f"ENVI\nsamples = {width}\nlines = {count}\nbands = 1\ndata type = {code}\ninterleave = bsq\nbyte order = 0\n".encode()))
    head.close()


def orbit_xml(spark: SparkSession, path: str) -> DataFrame:
    """State vectors of an orbit file: utc, t (seconds from the first), positions, velocities, quality."""
    number = "double"
    shape = f"UTC string, X {number}, Y {number}, Z {number}, VX {number}, VY {number}, VZ {number}, Quality string"
    raw = spark.read.format("xml").option("rowTag", "OSV").schema(shape).load(path)
    utc = F.to_timestamp_ntz(F.regexp_replace(F.regexp_replace("UTC", "^UTC=", ""), "Z$", ""))
    micros = F.unix_micros(utc.cast("timestamp"))
    x = raw.select(utc.alias("utc"), micros.alias("us"), *(F.col(c).alias(c.lower()) for c in ("X", "Y", "Z", "VX", "VY", "VZ", "Quality")))
    first = x.agg(F.min("us")).first()[0] or 0
    return x.withColumn("t", (F.col("us") - first) / 1e6).drop("us")


def attitude_xml(spark: SparkSession, path: str) -> DataFrame:
    """Attitude of an attitude file: utc, angles in radians, quaternion."""
    shape = "utc string, roll double, pitch double, yaw double, q0 double, q1 double, q2 double, q3 double, qualityFlag string"
    raw = spark.read.format("xml").option("rowTag", "QST").schema(shape).load(path)
    utc = F.to_timestamp_ntz(F.regexp_replace(F.regexp_replace("utc", "^UTC=", ""), "Z$", ""))
    return raw.select(utc.alias("utc"), *(F.radians(c).alias(c) for c in ("roll", "pitch", "yaw")), "q0", "q1", "q2", "q3", F.col("qualityFlag").alias("quality"))


def electron_content(spark: SparkSession, path: str) -> DataFrame:
    """Electron content of a JSON file of parallel lists: utc, and content below the orbit at near and far range."""
    raw = spark.read.option("multiLine", True).json(path)
    x = raw.select(F.explode(F.arrays_zip("utc", "totTecNr", "topTecNr", "totTecFr", "topTecFr")).alias("r")).select("r.*")
    return x.select(F.to_timestamp_ntz("utc").alias("utc"), (F.col("totTecNr") - F.col("topTecNr")).alias("near"), (F.col("totTecFr") - F.col("topTecFr")).alias("far"))


def plain_yaml(text: str) -> dict:
    """Nested mappings of scalars and bracketed lists, as calibration files have them."""

    def scalar(s: str):
        s = s.strip()
        if s.startswith("[") and s.endswith("]"):
            return [scalar(x) for x in s[1:-1].split(",")] if s[1:-1].strip() else []
        if s[:1] in "\"'" and s[-1:] == s[:1] and len(s) > 1:
            return s[1:-1]
        if s.lower() in ("null", "~", ""):
            return None
        if s.lower() in ("true", "false"):
            return s.lower() == "true"
        for kind in (int, float):
            try:
                return kind(s)
            except ValueError:
                pass
        return s

    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth, (name, _, value) = len(line) - len(line.lstrip()), line.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            stack[-1][1][scalar(name)] = scalar(value)
        else:
            new: dict = {}
            stack[-1][1][scalar(name)] = new
            stack.append((depth, new))
    return root


def calibration(text: str, bandwidth: int) -> dict:
    """The calibration of a bandwidth in MHz: common values, and per polarisation those of the bandwidth's own section."""
    told = plain_yaml(text)
    own = told.get(f"{bandwidth}MHz", told.get(bandwidth, {}))
    return {k: v for k, v in told.items() if not isinstance(v, dict)} | (own if isinstance(own, dict) else {})


def records(spark: SparkSession, path: str, length: int, fields: list[tuple[str, int, str]]) -> DataFrame:
    """A file of fixed-length records: number and the fields (name, offset, format); formats as in ``struct``, or 'A8' for text that holds a number."""
    rows = spark.sparkContext.binaryRecords(path, length).zipWithIndex().map(lambda x: (x[1], bytearray(x[0]))).toDF("number long, data binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, list] = {"number": list(pdf["number"])}
            for name, at, form in fields:
                if form[0] == "A":
                    out[name] = [float(d[at : at + int(form[1:])].decode("ascii", "replace").strip() or "nan") for d in pdf["data"]]
                else:
                    out[name] = [float(struct.unpack_from(form, d, at)[0]) for d in pdf["data"]]
            yield pd.DataFrame(out)

    return rows.mapInPandas(run, "number long, " + ", ".join(f"{n} double" for n, *_ in fields))


#: Readers by product type; each takes a session and a folder and gives its tables by name.
PRODUCTS: dict[str, Callable[[SparkSession, str], dict[str, DataFrame]]] = {}


def product(kind: str):
    def register(f):
        PRODUCTS[kind] = f
        return f

    return register


def open_product(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a product folder, by the reader of the type that its metadata tells."""
    told = json.loads("\n".join(r["value"] for r in spark.read.text(f"{folder}/product.json").collect()))
    if told["type"] not in PRODUCTS:
        raise ValueError(f"no reader for products of type {told['type']}")
    return PRODUCTS[told["type"]](spark, folder)


def _tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


@product("slc")
def _slc(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return _tables(spark, folder, ["lines", "orbit"])


@product("raw")
def _raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return _tables(spark, folder, ["echo", "pulses", "swaths"])


@product("covariance")
def _covariance(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return _tables(spark, folder, ["terms"])


@product("interferogram")
def _interferogram(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return _tables(spark, folder, ["layers"])


def write_product(tables: dict[str, DataFrame], folder: str, kind: str, metadata: dict | None = None) -> None:
    """Writes tables as Parquet below a folder, image tables by frequency and polarisation where they have these, and the metadata that open_product reads."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        by = [c for c in ("frequency", "polarisation", "band") if c in df.columns]
        df.write.partitionBy(*by).parquet(f"{folder}/{name}") if by else df.write.parquet(f"{folder}/{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/product.json")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(json.dumps({"type": kind, **(metadata or {})}).encode()))
    out.close()


def copied_metadata(table: DataFrame, without: list[str], renamed: dict[str, str]) -> DataFrame:
    """A metadata table (name, value) without some names and those below them, and with parts of names replaced."""
    keep = F.lit(True)
    for x in without:
        keep = keep & ~((F.col("name") == x) | F.startswith("name", F.lit(x + "/")))
    name = F.col("name")
    for old, new in renamed.items():
        name = F.replace(name, F.lit(old), F.lit(new))
    return table.where(keep).withColumn("name", name)


def found(table: DataFrame, pattern: str, start: str = "/") -> DataFrame:
    """Names of a catalogue of groups and data sets that match a pattern, below a start."""
    return table.where(F.startswith("name", F.lit(start)) & F.col("name").rlike(pattern))


def tiles_within(catalogue: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Terrain tiles (tile, west, south, east, north) that a box meets; a box over 180 degrees is two."""
    if west > east:
        return tiles_within(catalogue, west, south, 180.0, north).unionByName(tiles_within(catalogue, -180.0, south, east, north)).distinct()
    return catalogue.where((F.col("west") < east) & (F.col("east") > west) & (F.col("south") < north) & (F.col("north") > south))


def updated(base: dict, new: dict) -> dict:
    """A nested mapping with the values of another put in, level by level."""
    out = dict(base)
    for k, v in new.items():
        out[k] = updated(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
