"""Phase unwrapping: tiles by branch cuts, then whole turns between tiles from the lines they share."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

TWO_PI = 2 * np.pi


def residues(phase: np.ndarray) -> np.ndarray:
    """Whole turns about each loop of 2 x 2 samples."""
    wrap = lambda x: np.rint(x / TWO_PI)
    a, b, c, d = phase[:-1, :-1], phase[:-1, 1:], phase[1:, 1:], phase[1:, :-1]
    return (wrap(a - b) + wrap(b - c) + wrap(c - d) + wrap(d - a)).astype(int)


def branch_cuts(charge: np.ndarray, shape: tuple[int, int], neutrons: np.ndarray | None = None, reach: int = 32) -> np.ndarray:
    """Samples that growth may not cross: straight cuts that join charges (and neutrons on the way) until a tree is neutral or meets the edge."""
    cut = np.zeros(shape, bool)
    todo = {(int(i), int(j)): int(q) for (i, j), q in np.ndenumerate(charge) if q}
    extra = {(int(i), int(j)) for i, j in np.argwhere(neutrons)} if neutrons is not None else set()
    used: set[tuple[int, int]] = set()

    def line(a: tuple[int, int], b: tuple[int, int]) -> None:
        n = max(abs(a[0] - b[0]), abs(a[1] - b[1]), 1)
        for k in range(n + 1):
            i, j = round(a[0] + (b[0] - a[0]) * k / n), round(a[1] + (b[1] - a[1]) * k / n)
            cut[min(i + 1, shape[0] - 1), min(j + 1, shape[1] - 1)] = True

    for start, q in list(todo.items()):
        if start in used:
            continue
        used.add(start)
        tree, total = [start], q
        for size in range(1, reach + 1):
            grown = True
            while total and grown:
                grown = False
                for node in list(tree):
                    i, j = node
                    if min(i, j, shape[0] - 2 - i, shape[1] - 2 - j) < size:
                        edge = min(((i, (-1, j)), (j, (i, -1)), (shape[0] - 2 - i, (shape[0] - 2, j)), (shape[1] - 2 - j, (i, shape[1] - 2))), key=lambda e: e[0])[1]
                        line(node, (max(edge[0], -1), max(edge[1], -1)))
                        total = 0
                        break
                    near = [(i + di, j + dj) for di in range(-size, size + 1) for dj in range(-size, size + 1) if max(abs(di), abs(dj)) == size]
                    for at in near:
                        if at in tree or at not in todo and at not in extra:
                            continue
                        line(node, at)
                        tree.append(at)
                        grown = True
                        if at in todo and at not in used:
                            used.add(at)
                            total += todo[at]
                        if not total:
                            break
                    if not total:
                        break
            if not total:
                break
    return cut


def unwrap_tile(phase: np.ndarray, neutrons: np.ndarray | None = None, valid: np.ndarray | None = None, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Unwrapped phase and component number (0: none) of a tile, grown from seeds without crossing cuts.

    A cut sample takes its phase from a neighbour but is not grown from and not counted.
    """
    shape = phase.shape
    cut = branch_cuts(residues(phase), shape, neutrons) if min(shape) > 1 else np.zeros(shape, bool)
    bad = np.isnan(phase) if valid is None else ~valid | np.isnan(phase)
    label, out, n = np.zeros(shape, int), np.full(shape, np.nan), 0
    for seed in np.ndindex(*shape):
        if label[seed] or bad[seed] or cut[seed]:
            continue
        n += 1
        label[seed], out[seed] = n, phase[seed]
        queue, count, members = deque([seed]), 1, [seed]
        while queue:
            i, j = queue.popleft()
            for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if 0 <= a < shape[0] and 0 <= b < shape[1] and not label[a, b] and not bad[a, b]:
                    label[a, b] = n
                    out[a, b] = phase[a, b] + TWO_PI * np.rint((out[i, j] - phase[a, b]) / TWO_PI)
                    members.append((a, b))
                    if not cut[a, b]:
                        count += 1
                        queue.append((a, b))
        if count < least:
            for m in members:
                label[m], out[m] = 0, np.nan
            n -= 1
    return out, label


def unwrapped(raster: DataFrame, lines: int, least: int = 1) -> DataFrame:
    """Unwrapped phase of a raster of lines (line, values): line, values, component (array).

    Blocks of ``lines`` lines, each with the first line of the next, are unwrapped on their
    own. Two blocks' copies of the line they share give each pair of components their whole
    turns; those are added up from the first block down over the components, a table of a row
    or two per block.
    """
    dealt = raster.withColumn("block", F.explode(F.sequence(F.floor((F.col("line") - 1) / lines), F.floor(F.col("line") / lines)))).where("block >= 0")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line")
        phase = np.array([np.asarray(v, float) for v in pdf["values"]])
        out, label = unwrap_tile(phase, least=least)
        return pd.DataFrame({"block": key[0], "line": pdf["line"].to_numpy(), "values": list(out), "label": list(label)})

    tiles = written(dealt.groupBy("block").applyInPandas(run, "block long, line long, values array<double>, label array<int>"), "tiles")
    seam = tiles.where(F.col("line") % lines == 0)
    own = seam.where(F.floor(F.col("line") / lines) == F.col("block")).select("line", F.posexplode(F.arrays_zip("values", "label")).alias("pixel", "b"))
    above = seam.where(F.floor(F.col("line") / lines) == F.col("block") + 1).select("line", F.posexplode(F.arrays_zip("values", "label")).alias("pixel", "a"))
    both = own.join(above, ["line", "pixel"]).where("a.label > 0 and b.label > 0").select((F.col("line") / lines).cast("long").alias("block"), F.col("b.label").alias("label"), F.col("a.label").alias("up"), F.rint((F.col("a.values") - F.col("b.values")) / TWO_PI).alias("turns"))
    votes = both.groupBy("block", "label", "up", "turns").agg(F.count("*").alias("n"))
    best = votes.groupBy("block", "label").agg(F.max_by(F.struct("up", "turns"), F.struct("n", -F.col("turns"))).alias("v"))
    links = best.select("block", "label", "v.up", "v.turns").toLocalIterator()
    # a row for each component that touches the block before: added up in the order of blocks
    total: dict[tuple[int, int], int] = {}
    for x in sorted(links, key=lambda x: (x["block"], x["label"])):
        total[x["block"], x["label"]] = int(x["turns"]) + total.get((x["block"] - 1, x["up"]), 0)
    spark = raster.sparkSession
    shift = spark.createDataFrame([(b, k, t) for (b, k), t in total.items()] or [(-1, -1, 0)], "block long, k int, turns long")
    rows = tiles.where(F.floor(F.col("line") / lines) == F.col("block")).select("block", "line", F.posexplode(F.arrays_zip("values", "label")).alias("pixel", "z"))
    rows = rows.join(shift, (rows.block == shift.block) & (F.col("z.label") == F.col("k")), "left").select("line", "pixel", (F.col("z.values") + TWO_PI * F.coalesce("turns", F.lit(0))).alias("value"), F.col("z.label").alias("component"))
    return rows
