"""Benchmark decontamination with DataFrame functions only.

All windows of ten words of the benchmark form a hash set that every executor holds,
keyed by each window's longest word. The scan looks every word of a document up in it
and, at a hit, compares the window around the word with the test n-gram word by word.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, unused

#: Bytes of windows, with their items, that are broadcast at most; beyond, the join shuffles.
BROADCAST = 64 << 20
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text: runs of digits, letters a-z and characters beyond ASCII, after lower-casing A-Z."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), NOT_WORD), "")


def windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Distinct windows of the items: gram (array of words), items, anchor (its longest word), at (the anchor's place)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    grams = items.select(
        "item_id",
        F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {size}, 0)), i -> slice(w, i + 1, {size}))")).alias("gram"),
    )
    grams = grams.groupBy("gram").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    anchor = F.expr("array_max(transform(gram, (x, i) -> struct(length(x) as n, -i as at, x as anchor)))")
    return grams.withColumn("a", anchor).select("gram", "items", "a.anchor", (-F.col("a.at")).alias("at"))


def window_hashes(size: int) -> Column:
    """Hashes of all windows of so many words of the array w, which has as many at least."""
    return F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.xxhash64(F.slice("w", i + 1, size)))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, broadcast: int = BROADCAST) -> DataFrame:
    """Marks the words of docs that lie in any occurrence of a benchmark window.

    An item of fewer words than ``size``, but not none, is one window. Returns one row per
    row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Null texts have
    no words; a null item_id is not counted as an item, though its windows hit; repeated
    rows get the same row each; an empty benchmark hits nothing; only doc_id, text and
    item_id, text are read.
    """
    wanted = windows(benchmark.select("item_id", "text"), size)
    docs = docs.select("doc_id", "text")
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    split = keyed.select("doc_id", "row", words(F.col("text")).alias("w"))
    begin = F.col("pos") - F.col("at")
    size_of = F.octet_length(F.array_join("gram", " ")) + F.octet_length(F.array_join("items", ",")) + 64
    if (wanted.agg(F.sum(size_of)).first()[0] or 0) <= broadcast:
        # outer, as the inner form would split every text a second time to filter on its size
        placed = split.select("doc_id", "row", "w", F.posexplode_outer("w").alias("pos", "anchor"))
        placed = placed.join(F.broadcast(wanted), "anchor")
        placed = placed.where((begin >= 0) & (F.slice("w", F.greatest(begin, F.lit(0)) + 1, F.size("gram")) == F.col("gram")))
        hits = placed.select("doc_id", "row", begin.alias("b"), (begin + F.size("gram")).alias("e"), "items")
    else:
        # by the hash of whole windows, as a common word would bring its places to one task; no more than ``size`` lengths
        lengths = sorted(x["n"] for x in wanted.select(F.size("gram").alias("n")).distinct().collect())
        hashed = [
            split.where(F.size("w") >= n).select("row", F.lit(n).alias("n"), F.posexplode(window_hashes(n)).alias("b", "h"))
            for n in lengths
        ]
        placed = reduce(DataFrame.unionByName, hashed).join(wanted.select(F.size("gram").alias("n"), F.xxhash64("gram").alias("h"), "gram", "items"), ["n", "h"])
        placed = placed.select("row", "b", "gram", "items")
        hits = placed.join(split.dropDuplicates(["doc_id", "row"]), "row").where(F.slice("w", F.col("b") + 1, F.size("gram")) == F.col("gram"))
        hits = hits.select("doc_id", "row", "b", (F.col("b") + F.size("gram")).alias("e"), "items")
    order = Window.partitionBy("doc_id", "row").orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("b"), F.coalesce(F.max("e").over(order), F.col("b"))))
    hits = hits.distinct().withColumn("new", covered)
    found = hits.groupBy("doc_id", "row").agg(
        F.sum("new").cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    found = found.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "n_hit", "items")
    count = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    out = keyed.select("doc_id", "row", count.alias("n_words"))
    out = out.join(found, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """docs without its contaminated rows, all columns kept.

    A row is told by its doc_id and two hashes of its text, so null and shared doc_ids are
    judged by each row's own text; rows that repeat go or stay together. Null and empty texts,
    and all rows where the benchmark has no words, stay; columns may have any name.
    """
    a, b, key = (unused(docs, x) for x in ("row_a", "row_b", "row_key"))
    keyed = docs.withColumns({a: F.xxhash64("doc_id", "text"), b: F.xxhash64(F.lit(size), "text", "doc_id")})
    row = F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col("doc_id").alias("d"))
    bad = contamination(keyed.select(row.alias("doc_id"), "text"), benchmark, size).where("contaminated")
    bad = bad.select(F.col("doc_id").alias(key)).distinct()
    same = (keyed[a] == bad[key]["a"]) & (keyed[b] == bad[key]["b"]) & keyed["doc_id"].eqNullSafe(bad[key]["d"])
    return keyed.join(bad, same, "left_anti").select(*columns(docs))
