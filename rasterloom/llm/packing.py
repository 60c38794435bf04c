"""Packing token streams into fixed windows with a controlled mixture of sources.

Deficit round-robin in closed form: token j of a queue with weight w is due at virtual
time (j + 1/2) / w, and windows take tokens in that order. So each window holds each
source's share of its room to within a token, what a source is owed passes to the next
window, and once a queue is empty the others share its room by their weights. How many
tokens of every queue lie before any window follows from the queues' sizes alone, which
lets every partition cut its own documents: the deficits carry over exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder, slices

#: Cells (windows by queues) of the boundaries that are held at once.
CELLS = 1 << 19


def _tokenise(path: str, end: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        before: dict[str | None, int] = {}
        for batch in batches:
            for rows in slices(batch):
                ids = [np.append(x, np.array([end], enc.dtype)) for x in enc.encode(rows["text"].to_pylist())]
                starts = []
                for source, x in zip(rows["queue"].to_pylist(), ids, strict=True):
                    starts.append(before.get(source, 0))
                    before[source] = starts[-1] + len(x)
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], rows["queue"], pa.array(np.full(n, part, np.int64)), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["doc_id", "queue", "part", "at", "n", "ids"],
                )

    return run, f"doc_id {kind}, queue string, part long, at long, n long, ids binary"


def drawn(window: np.ndarray, sizes: np.ndarray, weights: np.ndarray, room: int) -> np.ndarray:
    """Tokens of every queue that lie before each window: an array (windows, queues), each row's sum room * window."""
    want = np.minimum(window.astype(np.int64) * room, int(sizes.sum()))

    def due(v: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(v[:, None] * weights + 0.5), 0, sizes).astype(np.int64)

    # never more than half a token of each queue off the even flow; past the end of a queue the bracket is open above
    low = np.maximum((want - len(sizes)) / weights.sum(), 0.0)
    high = (want + len(sizes)) / weights.sum()
    high = np.where(due(high).sum(axis=1) < want, (sizes / weights).max() + 1, high)
    close = min(len(sizes), room // 2)  # as windows lie ``room`` apart, brackets this narrow never overlap
    for _ in range(80):
        if ((due(high) - due(low)).sum(axis=1) <= close).all():
            break
        mid = (low + high) / 2
        over = due(mid).sum(axis=1) > want
        low, high = np.where(over, low, mid), np.where(over, mid, high)
    counts = due(low)
    more = due(high) - counts  # due at nearly the same moment: in the queues' order
    spare = want - counts.sum(axis=1)
    first = np.cumsum(more, axis=1) - more
    out = counts + np.clip(spare[:, None] - first, 0, more)
    return np.where((want == sizes.sum())[:, None], sizes, out)


def _cut(queues: list, sizes: list[int], weights: list[float], room: int, width: int):
    names = {q: i for i, q in enumerate(queues)}
    sizes_, weights_ = np.array(sizes, np.int64), np.array(weights, float)
    total = int(sizes_.sum())
    dtype = np.dtype("<u2" if width == 2 else "<u4")
    most = max(1, min(512, CELLS // len(queues)))

    def window_of(queue: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The window of each queue's token: the last whose count before it is not over ``at``."""
        v = (at + 0.5) / weights_[queue]
        place = np.zeros(len(at))
        for w, size in zip(weights_, sizes_, strict=True):
            place += np.clip(v * w, 0, size)
        guess = np.clip((place / room).astype(np.int64), 0, max(0, (total - 1) // room))
        for _ in range(64):
            low = drawn(guess, sizes_, weights_, room)[np.arange(len(at)), queue] > at
            high = drawn(guess + 1, sizes_, weights_, room)[np.arange(len(at)), queue] <= at
            if not (low | high).any():
                break
            guess = guess - low + high
        return guess

    def pieces(rows: pa.RecordBatch, doc: np.ndarray, window: np.ndarray, queue: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """What each window holds of each document: doc and window go in pairs."""
        met, where = np.unique(np.concatenate([window, window + 1]), return_inverse=True)
        table = drawn(met, sizes_, weights_, room)
        low, high = table[where[: len(doc)]], table[where[len(doc) :]]
        mine = np.arange(len(doc)), queue[doc]
        begin = np.maximum(at[doc], low[mine])
        stop = np.minimum((at + n)[doc], high[mine])
        taken = high - low
        offset = (np.cumsum(taken, axis=1) - taken)[mine] + begin - low[mine]
        keep = np.flatnonzero(stop > begin)
        doc, window, begin, stop, offset = (x[keep] for x in (doc, window, begin, stop, offset))
        crc, held, wide = [], -1, memoryview(b"")
        for d, b, e in zip(doc.tolist(), (4 * (begin - at[doc])).tolist(), (4 * (stop - at[doc])).tolist(), strict=True):
            if d != held:
                held, wide = d, memoryview(np.frombuffer(rows["ids"][d].as_py(), dtype).astype("<u4").tobytes())
            crc.append(zlib.crc32(wide[b:e]))
        return pa.RecordBatch.from_arrays(
            [rows["doc_id"].take(pa.array(doc)), pa.array(begin - at[doc]), pa.array(stop - begin), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(window), pa.array(offset)],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                rows = batch.slice(start, most)
                queue = np.array([names[x] for x in rows["queue"].to_pylist()], np.int64)
                at, n = rows["at"].to_numpy(), rows["n"].to_numpy()
                first, last = window_of(queue, at), window_of(queue, at + n - 1)
                for a in range(0, len(n), 16):
                    some = np.arange(a, min(a + 16, len(n)))
                    doc = np.repeat(some, (last - first + 1)[some])
                    step = np.arange(len(doc)) - np.repeat(np.cumsum((last - first + 1)[some]) - (last - first + 1)[some], (last - first + 1)[some])
                    per = max(1, CELLS // len(queues))
                    for at_pair in range(0, len(doc), per):
                        part = slice(at_pair, at_pair + per)
                        yield pieces(rows, doc[part], (first[doc] + step)[part], queue, at, n)

    return run


def pack(docs: DataFrame, path: str, end: int = 1, room: int = 2048, weights: dict[str | None, float] | None = None) -> DataFrame:
    """Packs all documents' ids, each document followed by ``end``, into windows of ``room`` ids.

    weights gives the sources' target shares (by default their shares of all tokens, which
    empties all queues together; a source it does not name gets its own share of tokens).
    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Every source is a queue of its own, however many there are; memory doesn't grow with
    their number, but the time for a window does. Only the last window is short. Null and empty texts hold ``end`` alone; a null source is
    a queue of its own; repeated rows are packed as often as they occur; an empty table
    gives no row; columns other than doc_id, text and source are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.col("source").cast("string").alias("queue"))
    run, shape = _tokenise(path, end, kind)
    ids = written(docs.mapInArrow(run, shape), "ids")
    shares = written(ids.groupBy("queue", "part").agg(F.sum("n").alias("n")), "shares")
    found = sorted(((x["queue"], x["n"]) for x in shares.groupBy("queue").agg(F.sum("n").alias("n")).collect()), key=lambda x: (x[0] is not None, x[0]))
    empty = spark.createDataFrame([], f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    if not found:
        return empty
    total = sum(n for _, n in found)
    shared = [(weights or {}).get(q, n / total) for q, n in found]
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = shares.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("queue").alias("q"), F.col("part").alias("p"), "base")
    placed = ids.join(base, F.col("queue").eqNullSafe(F.col("q")) & (F.col("part") == F.col("p")))
    placed = placed.select("doc_id", "queue", (F.col("at") + F.col("base")).alias("at"), "n", "ids")
    return placed.mapInArrow(_cut([q for q, _ in found], [n for _, n in found], shared, room, encoder(path).dtype.itemsize), empty.schema)
