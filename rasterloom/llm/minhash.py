"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``m`` small hashes, each of ``r`` minimum values, are computed for a
document's shingle set; the ``m * m`` table keys are all pairs of one hash from either
collection. So ``2 * m * r`` minimum values serve ``m * m`` tables of ``2 * r`` rows.
A pair of Jaccard similarity s meets in a table with probability
``(1 - (1 - s**r)**m)**2``: 0.9991 at 0.85 with r = 2, m = 6, and 0.9984 at 0.8 with m = 7.

Equal sets become one class first. Each bucket then proves its members against its head
(a star, not all pairs), then against its most central member; buckets that still hold members of more than one component are
searched across components only, without pairs that lengths, sketches or the number of
shingles found nowhere else rule out; an odd sketch of the sets leaves little but pairs
that are links or almost. Every candidate is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns as columns_of
from .common import components, drop, hold, join_counted, unused, written

SKETCH = 64
#: Bits of a set's odd sketch, the parity of its shingles by hash; sets differ in at least as many shingles as their sketches do in bits.
ODD = 1024
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 32, SKETCH, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, SKETCH, dtype=np.uint32)
_C = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: Members of a bucket that are compared with each other in one part.
SPLIT = 512


class _Hashes(dict):
    """64-bit hashes of words; cleared when full, so a worker's memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    Words are runs of bytes other than space and \\t..\\r after lower-casing A-Z; a text of
    fewer than k words, but not none, is one shingle; null and empty texts have none.
    """
    out: list[np.ndarray] = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        n = len(words)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
        w = min(n, k)
        s = np.full(n - w + 1, w, np.uint64)
        for i in range(w):
            s += h[i : n - w + 1 + i] * _C[i]
        out.append(np.unique(_mix(s)))
    return out


def _lists(values: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, len(values) + 1, width, dtype=np.int32), pa.array(values))


def _names(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit hashes of each set; with its size they name it."""
    return np.add.reduceat(flat, starts), np.bitwise_xor.reduceat(_mix(flat + np.uint64(0x9E3779B97F4A7C15)), starts)


def _signatures(sets: list[np.ndarray], r: int, m: int) -> tuple[np.ndarray, ...]:
    """The two hashes that name each set, its m * m keys and its SKETCH low bytes as longs."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    h1, h2 = _names(flat, starts)
    x = (flat >> np.uint64(32)).astype(np.uint32)
    low = np.stack([np.minimum.reduceat(x * a + b, starts) for a, b in zip(_A, _B, strict=True)], axis=1)
    small = np.zeros((len(sets), 2 * m), np.uint64)
    for i in range(2 * m):
        for j in range(r):
            small[:, i] = _mix(small[:, i] + low[:, i * r + j].astype(np.uint64) * _C[j] + np.uint64(i))
    keys = _mix(small[:, :m, None] * _C[40] + small[:, None, m:] * _C[41])
    tables = np.arange(m * m, dtype=np.uint64) * _C[42]
    keys = _mix(keys.reshape(len(sets), m * m) + tables)
    sketch = (low & np.uint32(255)).astype(np.uint8).view(np.int64)
    return h1.view(np.int64), h2.view(np.int64), keys.view(np.int64), sketch


def _scan(k: int, r: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("minhash", _HASHES.clear)
        for batch in batches:
            at, total = 0, batch.num_rows
            while at < total:
                part = batch.slice(at, 256)
                at += part.num_rows
                sets = shingle_sets(part["text"].to_pylist(), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                ids, text = part["doc_id"], part["t"]
                n = np.array([len(s) for s in sets], np.int64)
                for a in range(0, len(full), 64):
                    rows = full[a : a + 64]
                    h1, h2, keys, sketch = _signatures([sets[i] for i in rows], r, m)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(rows)), text.take(pa.array(rows)), pa.array(n[rows]), pa.array(h1), pa.array(h2), _lists(keys.ravel(), m * m), _lists(sketch.ravel(), SKETCH // 8)],
                        ["doc_id", "t", "n", "h1", "h2", "keys", "sketch"],
                    )
                none = np.flatnonzero(n == 0)
                if len(none):
                    void = pa.nulls(len(none), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(none)), text.take(pa.array(none)), pa.array(n[none]), void, void, pa.nulls(len(none), pa.list_(pa.int64())), pa.nulls(len(none), pa.list_(pa.int64()))],
                        ["doc_id", "t", "n", "h1", "h2", "keys", "sketch"],
                    )

    return run


def _set_rows(k: int):
    """The sets of the classes asked for, from rows with their doc_ids: rows of another text under that doc_id are left out, repeated ones told once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("minhash", _HASHES.clear)
        told: tuple = (None, set())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets, rows = shingle_sets(part["text"].to_pylist(), k), []
                for i, (doc, node, h1, h2) in enumerate(zip(*(part[x].to_pylist() for x in ("doc_id", "node", "h1", "h2")), strict=True)):
                    if doc != told[0]:
                        told = (doc, set())
                    if len(sets[i]) and node not in told[1]:
                        a, b = _names(sets[i], np.zeros(1, np.int64))
                        if (a.view(np.int64)[0], b.view(np.int64)[0]) == (h1, h2):
                            told[1].add(node)
                            rows.append(i)
                sets = [sets[i] for i in rows]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = np.concatenate([*sets, np.empty(0, np.uint64)])
                odd = [np.packbits((np.bincount((s % np.uint64(ODD)).astype(np.int64), minlength=ODD) & 1).astype(np.uint8)).view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part["node"].take(pa.array(rows, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64))), _lists(np.concatenate([*odd, np.empty(0, np.int64)]), ODD // 64)],
                    ["node", "words", "odd"],
                )

    return run


def _differ(a: str, b: str, longs: int = SKETCH // 8) -> Column:
    """How many bits of two arrays of longs differ; of sketches, about four for each minimum value that does."""
    return reduce(Column.__add__, (F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(longs)))


def _labelled(docs: DataFrame, k: int, per_cent: int, r: int, m: int) -> DataFrame:
    """Per row of docs: doc_id, t (a hash of its text), n, and its group c and component_id, null where it links with nothing by rule."""
    s = per_cent / 100
    # 5.5 standard deviations over the bits that a pair just at the threshold has different
    bits = int(SKETCH * (1 - s) * 4 + 5.5 * (SKETCH * (1 - s) * (s * 16 + 2)) ** 0.5)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    shape = f"doc_id {kind}, t long, n long, h1 long, h2 long, keys array<long>, sketch array<long>"
    signed = written(docs.withColumn("t", F.xxhash64("text")).mapInArrow(_scan(k, r, m), shape), "signed")
    live = signed.where("n > 0 and doc_id is not null")
    classes = live.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("doc"), F.any_value("keys").alias("keys"), F.any_value("sketch").alias("sketch"))
    # numbers given once and written: a doc_id that comes with several texts is in several classes
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    spread = classes.select("node", "n", F.explode("keys").alias("key"))
    heads = written(spread.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1"), "heads")
    members = written(join_counted(spread, heads, ["key"], "size", ["node"]), "members")
    lone = classes.select("node", "n", "sketch")

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = classes.join(wanted, "node").select(F.col("doc").alias("doc_id"), "node", "h1", "h2")
        return written(docs.join(wanted.hint("merge"), "doc_id").mapInArrow(_set_rows(k), "node long, words array<long>, odd array<long>"), "sets")

    def confirmed(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """Of pairs (u, v), those whose full sets are similar enough."""
        pairs, given = written(pairs, "pairs"), sets is not None
        if not given:
            sets = sets_of(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct())
        both = pairs.join(sets.select(F.col("node").alias("u"), F.col("words").alias("a")), "u").join(
            sets.select(F.col("node").alias("v"), F.col("words").alias("b")), "v"
        )
        both = both.select("u", "v", (F.size("a") + F.size("b")).cast("long").alias("total"), F.size(F.array_intersect("a", "b")).cast("long").alias("common"))
        links = written(both.where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * per_cent).select("u", "v").distinct(), "links")
        if not given:
            drop(sets)
        drop(pairs)
        return links

    def likely(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (u, v), those that lengths and sketches allow."""
        pairs = pairs.join(lone.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su")), "u")
        pairs = pairs.join(lone.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv")), "v")
        near = F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * per_cent
        return pairs.where(near & (_differ("su", "sv") <= bits)).select("u", "v")

    stars = confirmed(likely(members.where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v")).distinct()))
    first = written(components(stars), "first")
    labelled = members.join(first.select("node", F.col("component").alias("c")), "node", "left")
    labelled = labelled.select("key", "node", "n", F.coalesce("c", "node").alias("c"))
    mixed_keys = labelled.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size")).where("low <> high")
    mixed_keys = written(mixed_keys.select("key", "size"), "keys")
    mixed = written(join_counted(labelled, mixed_keys, ["key"], "size", ["node"]), "mixed")
    sets = sets_of(mixed.select("node").distinct())
    # Shingles that no other document of an open bucket has can't be common to any pair still in question.
    own = sets.select("node", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"), F.min("node").alias("node"))
    own = own.where("df = 1").groupBy("node").agg(F.count("*").alias("own"))
    open_ = mixed.join(lone.select("node", "sketch"), "node").join(own, "node", "left").join(sets.select("node", "odd"), "node")
    open_ = open_.withColumn("most", F.col("n") - F.coalesce("own", F.lit(0))).where(F.col("most") * 100 >= F.col("n") * per_cent)
    open_ = written(open_.select("key", "node", "n", "c", "sketch", "odd", "most"), "open")
    columns = ("node", "n", "c", "sketch", "odd", "most")
    most = F.least("most1", "most2")
    near = (most * 100 >= (F.col("n1") + F.col("n2") - most) * per_cent) & (_differ("sketch1", "sketch2") <= bits)
    near = near & (_differ("odd1", "odd2", ODD // 64) * (100 + per_cent) <= (F.col("n1") + F.col("n2")) * (100 - per_cent))

    def sides(x: DataFrame, i: int, by: tuple[str, ...] = ("key",)) -> DataFrame:
        return x.select(*by, *(F.col(c).alias(f"{c}{i}") for c in columns))

    # a second star, about the member of each bucket with the fewest shingles of its own: mostly what the others were edited from
    core = open_.groupBy("key").agg(F.min_by(F.struct(*columns), F.struct(F.col("n") - F.col("most"), "node")).alias("core"), F.count("*").alias("rows"))
    core = written(sides(core.select("key", "rows", "core.*"), 2, ("key", "rows")), "cores")
    again = join_counted(sides(open_, 1), core, ["key"], "rows", ["node1"]).where(F.col("c1") != F.col("c2")).where(near)
    second = confirmed(again.select(F.least("node1", "node2").alias("u"), F.greatest("node1", "node2").alias("v")).distinct(), sets)
    merged = written(components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(second)), "merged")
    open_now = open_.drop("c").join(merged.select("node", F.col("component").alias("c")), "node", "left").withColumn("c", F.coalesce("c", "node"))
    still = open_now.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("rows")).where("low <> high")
    still = written(still.select("key", F.ceil(F.col("rows") / SPLIT).alias("parts"), "rows"), "still")
    rest = written(join_counted(open_now, still, ["key"], "rows", ["node"]).select("key", "parts", *columns), "rest")
    # a large bucket is cut into parts, and every two parts meet on their own, in tasks of their own
    part = F.pmod(F.xxhash64("node"), "parts")
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    left = rest.withColumn("p", part).withColumn("q", F.explode(every))
    right = rest.withColumn("q", part).withColumn("p", F.explode(every))
    across = sides(left, 1, ("key", "p", "q")).join(sides(right, 2, ("key", "p", "q")), ["key", "p", "q"])
    across = across.where((F.col("node1") < F.col("node2")) & (F.col("c1") != F.col("c2"))).where(near)
    more = confirmed(across.select(F.col("node1").alias("u"), F.col("node2").alias("v")).distinct(), sets)
    joined = written(components(merged.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)), "joined")
    for x in (heads, members, mixed_keys, mixed, sets, open_, core, still, rest, first, merged, stars, second, more):
        drop(x)
    named = classes.select("h1", "h2", "n", "node", "doc").join(joined, "node", "left").withColumn("c", F.coalesce("component", "node"))
    least = named.groupBy("c").agg(F.min("doc").alias("component_id"))
    named = named.join(least, "c").select("h1", "h2", F.col("n").alias("size"), "c", "component_id")
    x = signed.select("doc_id", "t", "n", "h1", "h2")
    out = x.join(named, (x.h1 == named.h1) & (x.h2 == named.h2) & (x.n == named["size"]) & x.doc_id.isNotNull(), "left")
    return out.select("doc_id", "t", "n", "c", "component_id")


def near_duplicates(docs: DataFrame, k: int = 5, per_cent: int = 80, r: int = 2, m: int = 7) -> DataFrame:
    """Groups documents whose distinct k-word shingle sets have Jaccard similarity >= per_cent / 100.

    Returns one row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id
    reachable over links, its own included), kept (doc_id = component_id). Only doc_id and
    text are read, so other columns may have any name. Links are between texts: rows that
    repeat a doc_id and its text share one component, and a doc_id that comes with another
    text is another document that links by that text alone. Null, empty and wordless texts
    have n_shingles 0 and link with nothing. A null doc_id links with nothing: component_id
    null, kept true. All rows of the smallest doc_id are kept. An empty table gives an empty
    result.
    """
    component = F.coalesce("component_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return _labelled(docs, k, per_cent, r, m).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def clean(docs: DataFrame, k: int = 5, per_cent: int = 80, r: int = 2, m: int = 7) -> DataFrame:
    """docs with one row for each group of near-duplicates: one of the smallest doc_id; all columns kept.

    A row is told by its doc_id and its own text, so a doc_id that comes with another text
    loses that text only if it is a copy. Of rows that repeat a kept doc_id and its words one
    stays. Rows with a null doc_id or without words are in no group and stay.
    """
    told = written(_labelled(docs, k, per_cent, r, m).where("component_id is not null").groupBy("doc_id", "t", "c", "component_id").agg(F.count("*").alias("rows")), "told")
    first = told.where("doc_id = component_id").groupBy("doc_id", "c").agg(F.min("t").alias("t1"), F.count("*").alias("texts"), F.max("rows").alias("rows"))
    odd = written(first.where("texts > 1 or rows > 1"), "odd")
    t, d, u = (unused(docs, x) for x in ("text_hash", "bad_doc", "bad_text"))
    keyed = docs.withColumn(t, F.xxhash64("text"))
    bad = told.where("doc_id <> component_id").select("doc_id", "t")
    several = odd.first() is not None
    if several:
        bad = bad.unionByName(told.where("doc_id = component_id").join(odd.select("doc_id", "c", "t1"), ["doc_id", "c"]).where("t <> t1").select("doc_id", "t"))
    bad = bad.select(F.col("doc_id").alias(d), F.col("t").alias(u))

    def same(x: DataFrame):
        return (keyed["doc_id"] == x[d]) & (keyed[t] == x[u])

    left = keyed.join(bad, same(bad), "left_anti")
    if several:
        again = odd.where("rows > 1").select(F.col("doc_id").alias(d), F.col("t1").alias(u))
        keyed = left
        one = keyed.join(again, same(again), "left_semi").dropDuplicates(["doc_id", t])
        left = keyed.join(again, same(again), "left_anti").unionByName(one)
    return left.select(*columns_of(docs))
