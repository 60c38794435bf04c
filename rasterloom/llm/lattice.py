"""Near-duplicate vectors by E8 lattice hashing.

A table projects unit vectors to ``blocks`` random 8-dimensional spaces and decodes each
projection to its nearest point of the lattice E8; the points together are the key. Each
vector is stored under its own cell and probes the cells next nearest to it as well.
Candidates are confirmed by their cosine in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-1, 1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((-1, 1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


ROOTS = _roots()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points with integer coordinates of even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    gap = x[odd] - near[odd]
    worst = np.abs(gap).argmax(axis=1)
    near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def _keys(unit: np.ndarray, tables: int, blocks: int, scale: float, probes: int, seed: int) -> np.ndarray:
    """Keys of every vector: (rows, tables, 1 + probes), its own cell first."""
    rng = np.random.default_rng(seed)
    dim = unit.shape[1]
    salt = rng.integers(1, 1 << 62, (blocks, 8), dtype=np.int64).astype(np.uint64) | np.uint64(1)
    out = np.empty((len(unit), tables, 1 + probes), np.uint64)
    for t in range(tables):
        cells, steps = [], []
        for b in range(blocks):
            x = unit @ rng.standard_normal((dim, 8)) * scale
            point = decode(x)
            gain = 2 * (x - point) @ ROOTS.T  # how much nearer x is to a neighbour than twice the radius
            best = np.argpartition(-gain, 2, axis=1)[:, :3]
            order = np.take_along_axis(gain, best, 1)
            best = np.take_along_axis(best, np.argsort(-order, axis=1), 1)
            cost = 2 - np.take_along_axis(gain, best, 1)
            own = (np.rint(point * 2).astype(np.int64).astype(np.uint64) * salt[b]).sum(axis=1)
            move = (np.rint(ROOTS * 2).astype(np.int64).astype(np.uint64) * salt[b]).sum(axis=1)
            cells.append(np.concatenate([own[:, None], own[:, None] + move[best]], axis=1))
            steps.append(np.concatenate([np.zeros((len(x), 1)), cost], axis=1))
        total, price = cells[0], steps[0]
        for c, s in zip(cells[1:], steps[1:], strict=True):
            total = (total[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + c[:, None, :]).reshape(len(unit), -1)
            price = (price[:, :, None] + s[:, None, :]).reshape(len(unit), -1)
        first = np.argsort(price, axis=1, kind="stable")[:, : 1 + probes]
        out[:, t] = np.take_along_axis(total, first, 1) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(t)
    return out


def _units(rows: list) -> tuple[list[int], list[np.ndarray]]:
    """The rows that can link, and their vectors divided by their norm."""
    at, out = [], []
    for i, v in enumerate(rows):
        if v and None not in v:
            x = np.array(v, float)
            big = np.abs(x).max()
            if np.isfinite(big) and big > 0:
                x = x / big  # keeps the norm of very large or small vectors finite
                at.append(i)
                out.append(x / np.sqrt((x * x).sum()))
    return at, out


def _scan(tables: int, blocks: int, scale: float, probes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                named = part["vec_id"].is_valid().to_pylist()
                at, units = _units([x if ok else None for x, ok in zip(part["embedding"].to_pylist(), named, strict=True)])
                rest = sorted(set(range(part.num_rows)) - set(at))
                if rest:
                    none = [pa.nulls(len(rest), t) for t in (pa.binary(), pa.list_(pa.float64()), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([part["vec_id"].take(pa.array(rest)), *none], ["vec_id", "same", "unit", "keys"])
                for dim in {len(x) for x in units}:
                    rows = [i for i, x in zip(at, units, strict=True) if len(x) == dim]
                    unit = np.array([x for x in units if len(x) == dim])
                    keys = _keys(unit, tables, blocks, scale, probes, seed + dim).reshape(len(rows), -1).view(np.int64)
                    same = [hashlib.blake2b(np.round(x, 15).tobytes(), digest_size=16).digest() for x in unit + 0.0]
                    yield pa.RecordBatch.from_arrays(
                        [part["vec_id"].take(pa.array(rows)), pa.array(same, pa.binary()), pa.array(list(unit), pa.list_(pa.float64())), pa.array(list(keys), pa.list_(pa.int64()))],
                        ["vec_id", "same", "unit", "keys"],
                    )

    return run


def _cosine(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch["a"], batch["b"]
            if not batch.num_rows:
                continue
            n = pa.compute.list_value_length(a).to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(n)[:-1]))
            cos = np.add.reduceat(a.flatten().to_numpy() * b.flatten().to_numpy(), starts)
            keep = pa.array(cos >= least)
            yield pa.RecordBatch.from_arrays([batch["u"].filter(keep), batch["v"].filter(keep)], ["u", "v"])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.95, tables: int = 14, blocks: int = 2, scale: float = 0.6, probes: int = 5, seed: int = 8) -> DataFrame:
    """Links vectors whose cosine is at least ``least``, whatever their other columns.

    Returns one row per row of vectors: vec_id, n_links (other vectors linked directly),
    component_id (smallest vec_id reachable), kept. Vectors of different lengths never link;
    those that are null, empty, zero or hold null or non-finite values link with nothing.
    Vectors of equal direction form one class and are compared once; a class's links count
    for each of its vectors. Repeated rows count as vectors of their own; a vec_id that
    repeats with other vectors is one node, linked as any of them is; a null vec_id is
    never linked; an empty table gives an empty result. Misses a pair just at 0.95 with a probability below 0.01.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    vectors = vectors.select("vec_id", "embedding")
    shape = f"vec_id {kind}, same binary, unit array<double>, keys array<long>"
    hashed = written(vectors.mapInArrow(_scan(tables, blocks, scale, probes, seed), shape), "hashed")
    classes = hashed.where("same is not null").groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("unit").alias("unit"), F.any_value("keys").alias("keys"))
    classes = written(classes, "classes")
    probe = classes.select(F.col("rep").alias("x"), F.explode("keys").alias("key"))
    own = F.expr(f"filter(keys, (k, i) -> i % {1 + probes} = 0)")
    home = classes.select(F.col("rep").alias("y"), F.explode(own).alias("key"))
    pairs = probe.join(home, "key").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
    unit = classes.select("rep", "unit")
    pairs = pairs.join(unit.select(F.col("rep").alias("u"), F.col("unit").alias("a")), "u").join(unit.select(F.col("rep").alias("v"), F.col("unit").alias("b")), "v")
    pairs = pairs.where(F.size("a") == F.size("b"))
    links = written(pairs.mapInArrow(_cosine(least), f"u {kind}, v {kind}"), "links")
    joined = written(components(links), "joined")
    ends = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    count = ends.join(classes.select(F.col("rep").alias("v"), "copies"), "v").groupBy("u").agg(F.sum("copies").alias("others"))
    named = classes.join(joined, F.col("rep") == F.col("node"), "left").join(count, F.col("rep") == F.col("u"), "left")
    named = named.select("same", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = hashed.select("vec_id", "same").join(named, "same", "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
