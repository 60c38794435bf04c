"""Token ids in binary files whose document boundaries are Elias-Fano encoded.

A file holds one run of documents in ascending doc_id order::

    8 bytes   magic
    header    JSON length (u32) and JSON: counts, widths, section lengths, first doc_id
    ends      Elias-Fano code of each document's end within the id array
    doc_ids   Elias-Fano code of doc_id minus the first, null doc_ids left out
    ids       the concatenated ids, little-endian, u16 or u32

A code has three parts: low bits, upper bits in unary, and a directory with the place of
every 512th one bit of the upper bits (u32). The i-th value is found by select: from the
directory's entry over at most a few words. Nothing is decoded or built when a file is
opened, and there is no table of 64-bit offsets.
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, written
from .tokens import encoder, slices

MAGIC, SAMPLE, FILE_IDS = b"EFTOKEN1", 512, 1 << 22


class EliasFano:
    """A non-decreasing sequence of n values below ``bound`` in about n * (2 + log2(bound / n)) bits."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, directory: bytes):
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        bits = max(0, math.floor(math.log2(max(1, (int(values[-1]) + 1) / n))))
        tail = values & np.uint64((1 << bits) - 1)
        spread = ((tail[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros(-(-(int(ones[-1]) + 1) // 64) * 64, np.uint8)
        upper[ones] = 1
        low, high = (np.packbits(x, bitorder="little").tobytes() for x in (spread.ravel(), upper))
        return cls(n, bits, low, high, ones[::SAMPLE].astype("<u4").tobytes())

    def parts(self) -> tuple[bytes, bytes, bytes]:
        return self.low, self.high, self.directory

    def all(self) -> np.ndarray:
        """All values, by one scan of the upper bits."""
        if not self.n:
            return np.empty(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        tail = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1) if self.low_bits else 0
        return ((ones - np.arange(self.n)) << self.low_bits) + tail

    def _word(self, i: int) -> int:
        return int.from_bytes(self.high[8 * i : 8 * i + 8], "little")

    def select(self, i: int) -> int:
        """The i-th value alone: from the directory's one bit on by whole words, then by halves of the word."""
        d = i // SAMPLE * 4
        at, left = int.from_bytes(self.directory[d : d + 4], "little"), i % SAMPLE
        index = at >> 6
        word = self._word(index) >> (at & 63) << (at & 63)
        while (ones := word.bit_count()) <= left:
            left -= ones
            index += 1
            word = self._word(index)
        place = index << 6
        for half in (32, 16, 8, 4, 2, 1):
            below = word & ((1 << half) - 1)
            if (ones := below.bit_count()) <= left:
                left -= ones
                word >>= half
                place += half
            else:
                word = below
        first = i * self.low_bits
        raw = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8 + 1], "little")
        return ((place - i) << self.low_bits) | ((raw >> (first % 8)) & ((1 << self.low_bits) - 1))


def dump(doc_ids: list[int | None], ids: list[np.ndarray], dtype: np.dtype) -> bytes:
    """The bytes of one file; doc_ids ascend, nulls first."""
    nulls = sum(x is None for x in doc_ids)
    known = doc_ids[nulls:]
    codes = {"ends": EliasFano.of(np.cumsum([len(x) for x in ids]) if ids else np.empty(0)), "names": EliasFano.of(np.array([x - known[0] for x in known], np.uint64))}
    head = {"docs": len(ids), "nulls": nulls, "first": known[0] if known else 0, "width": dtype.itemsize}
    told = json.dumps(head | {k: [x.n, x.low_bits, *map(len, x.parts())] for k, x in codes.items()}).encode()
    parts = [MAGIC, struct.pack("<I", len(told)), told, *(y for x in codes.values() for y in x.parts())]
    return b"".join([*parts, *(np.asarray(x, dtype).tobytes() for x in ids)])


class TokenFile:
    """One file, opened: ``len``, ``doc_ids``, ``bounds(i)`` and ``ids(i)``; bounds come from select alone."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack_from("<I", data, 8)
        head = json.loads(data[12 : 12 + size])
        at, codes = 12 + size, []
        for n, bits, *lengths in (head["ends"], head["names"]):
            parts = []
            for length in lengths:
                parts.append(data[at : at + length])
                at += length
            codes.append(EliasFano(n, bits, *parts))
        self.ends, self.names = codes
        self.nulls, self.first, self.docs = head["nulls"], head["first"], head["docs"]
        dtype = np.dtype(f"<u{head['width']}")
        self.flat = np.frombuffer(data, dtype, (len(data) - at) // dtype.itemsize, at)

    def __len__(self) -> int:
        return self.docs

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.names.select(i - self.nulls) + self.first

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        return self.flat[slice(*self.bounds(i))]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _put(store: fs.FileSystem, temp: str, path: str) -> None:
    """Gives a finished file its name; one that another attempt of the task has put there holds the same bytes and stays."""
    there = lambda: store.get_file_info(path).type != fs.FileType.NotFound
    if not there():
        try:
            store.move(temp, path)
            return
        except OSError:
            if not there():
                raise
    store.delete_file(temp)


def _write(path: str, end: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, context = encoder(path), TaskContext.get()
        part, doc_ids, ids, size, count = context.partitionId(), [], [], 0, 0
        store, root = _open(folder)
        store.create_dir(root, recursive=True)

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, ids, size, count
            name = f"{part:06d}-{count:06d}.tok"
            temp = f"{root}/.{name}.{context.taskAttemptId()}"
            with store.open_output_stream(temp) as f:
                f.write(dump(doc_ids, ids, enc.dtype))
            _put(store, temp, f"{root}/{name}")
            out = pa.RecordBatch.from_pydict({"part": [part], "nth": [count], "file": [name], "docs": [len(ids)], "n": [size]}, pa.schema([("part", pa.int64()), ("nth", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("n", pa.int64())]))
            doc_ids, ids, size, count = [], [], 0, count + 1
            return out

        for batch in batches:
            for rows in slices(batch):
                for d, x in zip(rows["doc_id"].to_pylist(), enc.encode(rows["text"].to_pylist()), strict=True):
                    doc_ids.append(d)
                    ids.append(np.append(x, np.array([end], enc.dtype)))
                    size += len(ids[-1])
                    if size >= FILE_IDS:
                        yield flush()
        if ids:
            yield flush()

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for name, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    tokens = TokenFile(f.read())
                for a in range(0, len(tokens), 2048):
                    rows = []
                    for i in range(a, min(a + 2048, len(tokens))):
                        x, y = tokens.bounds(i)
                        rows.append((tokens.doc_id(i), x + base, y - x, zlib.crc32(tokens.flat[x:y].astype("<u4"))))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_files(docs: DataFrame, path: str, folder: str, end: int = 2) -> DataFrame:
    """Writes all documents' ids, each followed by ``end``, to files in ``folder``, in ascending doc_id order.

    Returns the table of files: part, nth, file, docs, n (ids), base (ids in the files before it).
    folder is a URI that every executor reaches. Null doc_ids come first, null texts count as
    empty, repeated doc_ids keep all their rows, an empty table makes no file; other columns
    are not read.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    files = written(ordered.mapInArrow(_write(path, end, folder), "part long, nth long, file string, docs long, n long"), "files")
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    # one row per partition of files: a few thousand at most, whatever the number of documents
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(before, "part")
    return placed.select("part", "nth", "file", "docs", "n", (F.col("base") + F.col("inner")).alias("base"))


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    n = files.sparkSession.sparkContext.defaultParallelism * 4
    return files.select("file", "base").repartition(n, "file").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    folder = scratch(docs.sparkSession, "tokens")
    return read_files(written(write_files(docs, path, folder, end), "files"), folder)
