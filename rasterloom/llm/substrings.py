"""Exact repeated substrings: removes every byte that an earlier ``size``-byte string covers.

Each ``size``-byte window is filed under its anchor, the gram of GRAM bytes with the
smallest hash in it, so equal windows have equal anchors at equal places. Consecutive
windows with one anchor are one stretch; a stretch whose bytes occurred before is removed
whole, and only the first occurrences of stretches that share an anchor but not all their
bytes are compared window by window. The first occurrence is found by partial minima; the
joins that hand it to the others deal the rows of very frequent keys to several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, join_counted, written

GRAM, CELLS = 32, 4
_RNG = np.random.default_rng(98)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SALT = _RNG.integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)
_PLACE = np.uint64((1 << 28) - 1)
#: Windows of a text that are handled at once; longer texts go piece by piece.
PIECE = 1 << 26


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` bytes at each place, by doubling."""
    whole, width, base, shift, out = _BYTE[data], 1, _BASE, 0, None
    n = len(data) - size + 1
    while True:
        if size & width:
            part = whole[shift : shift + n]
            out = part.copy() if out is None else out * base + part
            shift += width
        if width * 2 > size:
            return _mix(out)
        whole = whole[:-width] * base + whole[width:]
        width, base = width * 2, np.uint64(int(base) * int(base) & (1 << 64) - 1)


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, by doubling."""
    step, n = 1, len(x) - width + 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[width - step : width - step + n])


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def stretches(data: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """The stretches of a text: anchor hash, content hash, first and last window, and the anchor's place."""
    grams = _grams(data, GRAM)
    tagged = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    place = (_lowest(tagged, size - GRAM + 1) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [len(place)])) - 1
    anchor = place[first]
    # hash of a stretch of any length: two overlapping runs of its grams' sums, and its shape
    total = np.concatenate(([np.uint64(0)], np.cumsum(_mix(grams + _SALT[0]) * _powers(len(grams)))))
    end = last + size - GRAM + 1
    content = (total[end] - total[first]) * _inverse(len(grams))[first]
    shape = (end - first).astype(np.uint64) * _SALT[1] + (anchor - first).astype(np.uint64) * _SALT[2]
    return grams[anchor], _mix(content + shape), first, last, anchor


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> None:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((int(_SALT[3]), pow(int(_SALT[3]), -1, 1 << 64))):
            steps = np.full(max(n, 1 << 17), base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)


def _powers(n: int) -> np.ndarray:
    _grow(n)
    return _POWERS[0][:n]


def _inverse(n: int) -> np.ndarray:
    _grow(n)
    return _POWERS[1][:n]


def _packed(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """A stretch's first window, and how far its last window and its anchor lie from there, in one number."""
    return first.astype(np.int64) << 16 | (last - first).astype(np.int64) << 8 | (anchor - first).astype(np.int64)


def _scan(size: int, piece: int = PIECE):
    """Stretches: a, c, doc_id and place; of equal ones in a text all but the first with the place inverted, below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            out, held = [], 0

            def told(rows: list) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], ["a", "c", "doc_id", "place"])

            for i in range(batch.num_rows):
                data = np.frombuffer(_bytes(batch["text"][i].as_py()), np.uint8)
                parts = []
                for at in range(0, max(0, len(data) - size + 1), piece):
                    a, c, *places = stretches(data[at : at + piece + size - 1], size)
                    first, last, anchor = (x + at for x in places)
                    parts.append((a.view(np.int64), c.view(np.int64), _packed(first, last, anchor)))
                if not parts:
                    continue
                a, c, place = (np.concatenate(x) for x in zip(*parts, strict=True))
                _, where = np.unique(np.stack([a, c]), axis=1, return_index=True) if len(parts) > 1 else np.unique(c, return_index=True)
                again = np.ones(len(c), bool)
                again[where] = False
                out.append((a, c, np.full(len(a), ids[i]), np.where(again, ~place, place)))
                held += len(a)
                if held > 20_000:
                    yield told(out)
                    out, held = [], 0
            if out:
                yield told(out)

    return run


def _edges(size: int):
    """Per edge: hashes of its windows, and of CELLS strings that its windows share, by their place against the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = (size - GRAM) // CELLS
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(_bytes(batch["text"][i].as_py()), np.uint8)
                inner = size - step
                grams, cores = _grams(data, size), _grams(data, inner)
                edges = batch["edges"][i].values
                a, place = (edges.field(x).to_numpy() for x in ("a", "place"))
                first = place >> 16
                last, anchor = first + (place >> 8 & 255), first + (place & 255)
                # cell t holds the windows that begin (t + 1) * step - step + 1 .. (t + 1) * step bytes before the anchor
                n = last - first + 1
                doc = np.repeat(np.arange(len(a)), n)
                at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                cell = np.maximum(-(-(anchor[doc] - at) // step) - 1, 0)
                core = anchor[doc] - cell * step  # the string of ``inner`` bytes from here lies in every window of the cell
                cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (core[1:] != core[:-1]))))
                offsets = np.concatenate((cut, [len(doc)])).astype(np.int32)
                k = len(cut)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(a[doc[cut]]),
                        pa.array((cores[core[cut]] + (anchor[doc[cut]] - core[cut]).astype(np.uint64) * _SALT[1]).view(np.int64)),
                        pa.array(np.full(k, batch["doc_id"][i].as_py(), np.int64)),
                        pa.array(at[cut].astype(np.int32)),
                        pa.ListArray.from_arrays(offsets, pa.array(grams[at].view(np.int64))),
                    ],
                    ["a", "core", "doc_id", "at", "windows"],
                )

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            size, gone, runs, sha, texts = [], [], [], [], []
            for text, cover in zip(part["text"], part["cover"], strict=True):
                data = _bytes(text.as_py())
                spans = cover.values
                pieces, at, removed, n = [], 0, 0, 0
                if spans is not None and len(spans):
                    b, e = spans.field("b").to_numpy(), spans.field("e").to_numpy()
                    order = np.argsort(b, kind="stable")
                    b, e = b[order], np.maximum.accumulate(e[order])
                    cut = np.flatnonzero(np.concatenate(([True], b[1:] > e[:-1])))
                    for x, y in zip(b[cut].tolist(), e[np.concatenate((cut[1:], [len(b)])) - 1].tolist(), strict=True):
                        pieces.append(data[at:x])
                        removed += y - x
                        n += 1
                        at = y
                pieces.append(data[at:])
                left = b"".join(pieces)
                size.append(len(data))
                gone.append(removed)
                runs.append(n)
                sha.append(hashlib.sha256(left).hexdigest())
                texts.append(left)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha), pa.array(texts, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def repeats(docs: DataFrame, size: int = 100) -> DataFrame:
    """Spans [b, e) of docs' UTF-8 bytes that a ``size``-byte string covers which starts earlier too.

    Earlier: in a smaller doc_id, or before in the same document. Rows (doc_id, cover), at most
    two a document; the spans of a cover may overlap. doc_id must be a long without nulls,
    and rows that share one must share the text too; size is 255 at most.
    """
    found = docs.mapInArrow(_scan(size), "a long, c long, doc_id long, place long")
    groups = found.groupBy("a", "c").agg(F.min("doc_id").alias("o"), F.min_by(F.expr("if(place < 0, null, place)"), F.expr("if(place < 0, null, doc_id)")).alias("p"), F.count("*").alias("k"))
    groups = written(groups, "groups")
    twice = written(groups.where("k > 1").select("a", "c", "o", "k"), "twice")
    later = join_counted(found, twice, ["a", "c"], "k", ["doc_id", "place"]).where("doc_id <> o or place < 0")
    place = F.expr("if(place < 0, ~place, place)")
    first = F.shiftright(place, 16)
    span = F.struct(first.cast("int").alias("b"), (first + F.shiftright(place, 8).bitwiseAND(F.lit(255)) + size).cast("int").alias("e"))
    whole = written(later.groupBy("doc_id").agg(F.collect_list(span).alias("cover")), "whole")
    varied = written(groups.groupBy("a").agg(F.count("*").alias("n")).where("n > 1"), "varied")
    edges = join_counted(groups, varied, ["a"], "n", ["o", "p"]).select("a", F.col("o").alias("doc_id"), F.col("p").alias("place"))
    edges = written(edges.groupBy("doc_id").agg(F.collect_list(F.struct("a", "place")).alias("edges")), "edges")
    for x in (groups, twice, varied):
        drop(x)
    cells = docs.join(edges.hint("merge"), "doc_id").mapInArrow(_edges(size), "a long, core long, doc_id long, at int, windows array<long>")
    cells = written(cells, "cells")
    drop(edges)
    # a window can only repeat if the string that all windows of its cell hold does
    cores = written(cells.groupBy("a", "core").agg(F.count("*").alias("n")).where("n > 1"), "cores")
    likely = written(join_counted(cells, cores, ["a", "core"], "n", ["doc_id", "at"]).select("a", "doc_id", "at", "windows"), "likely")
    drop(cells)
    drop(cores)
    windows = likely.select("a", "doc_id", "at", F.posexplode("windows").alias("i", "w")).select("a", "w", "doc_id", (F.col("at") + F.col("i")).alias("at"))
    place = F.struct("doc_id", "at")
    twice = written(windows.groupBy("a", "w").agg(F.min(place).alias("o"), F.count("*").alias("k")).where("k > 1"), "windows")
    again = join_counted(windows, twice, ["a", "w"], "k", ["doc_id", "at"]).where(F.col("o") != place)
    single = again.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("at").alias("b"), (F.col("at") + size).alias("e"))).alias("cover"))
    cover = written(whole.unionByName(single), "cover")
    for x in (whole, likely, twice):
        drop(x)
    return cover


def _ranked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with a long of its own, ``at``, for every doc_id and text, in the order of doc_id; and the table of these."""
    keys = written(docs.groupBy("doc_id", F.xxhash64("text").alias("t")).agg(F.count("*").alias("rows")), "keys")
    ordered = written(keys.repartitionByRange("doc_id", "t").sortWithinPartitions("doc_id", "t").withColumn("at", F.monotonically_increasing_id()), "ranked")
    same = docs.withColumn("t", F.xxhash64("text")).join(ordered.select("doc_id", "t", "at"), ["doc_id", "t"])
    return same.select("at", "text"), ordered.select("at", "doc_id", "rows")


def without_repeats(docs: DataFrame, size: int = 100) -> DataFrame:
    """docs' texts without the bytes that an earlier ``size``-byte string covers.

    Returns one row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and
    kept (the remaining bytes). Null texts count as empty; a null doc_id counts as smaller
    than any other. Rows that repeat a doc_id and its text are one document and get the same
    result each; a doc_id that comes with several texts is several documents, in the order
    of a hash of their texts. Texts shorter than ``size`` lose nothing; texts of any length
    are handled, in pieces; an empty table gives an empty result; columns other than doc_id
    and text are not read.
    """
    least = -(1 << 63)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
    names = None
    if ids.where("low <> high").first() is not None:
        docs, names = _ranked(docs)
        docs = written(docs.dropDuplicates(["at"]).withColumnRenamed("at", "doc_id"), "texts")
    cover = repeats(docs, size).groupBy("doc_id").agg(F.flatten(F.collect_list("cover")).alias("cover"))
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = docs.join(cover.hint("merge"), "doc_id", "left").mapInArrow(_kept, shape)
    if names is not None:
        out = out.withColumnRenamed("doc_id", "at").join(names, "at").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
        out = out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(least)))
