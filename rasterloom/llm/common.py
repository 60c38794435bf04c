"""Shared folders, written tables and connected components for the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Deletes a plan's shuffle files when the plan is done; while a table is written nothing else needs them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The operator whose tables this Python worker keeps from task to task, and what clears them.
_HELD: dict[str, Callable[[], object]] = {}


def hold(owner: str, clear: Callable[[], object] = dict) -> None:
    """Says that this Python worker now serves ``owner``: what another operator kept for its own next task is cleared and given back to the system.

    Spark hands a worker from stage to stage, so an executor would otherwise hold what all of them keep.
    """
    if owner in _HELD:
        return
    had = list(_HELD.values())
    _HELD.clear()
    _HELD[owner] = clear
    for drop_tables in had:
        drop_tables()
    if had:
        give_back()


def give_back() -> None:
    """Gives memory that this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset (a local
    session, as in tests) a temporary folder of this machine takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table made by ``written`` once later tables no longer need it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df has not."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame) -> list:
    """df's columns, whatever signs their names hold."""
    return [F.col("`" + x.replace("`", "``") + "`") for x in df.columns]


#: Rows of one key from which a join deals them out, where they are also a thousandth of all rows; and into how many parts.
HOT, SALTS = 50_000, 64


def join_counted(left: DataFrame, right: DataFrame, by: list[str], count: str, spread: list[str]) -> DataFrame:
    """Inner join to right, a written table with one row per key and the number of its rows in left, so that no key meets in one task.

    Keys with more rows than HOT and a thousandth of all, at most a thousand of them, are
    broadcast to mark their rows, which are dealt out by ``spread``; right's rows for them
    are repeated for each part. right's column ``count`` is left out.
    """
    limit = max(HOT, (right.agg(F.sum(count)).first()[0] or 0) // 1000)
    salt, hot = unused(left, "salt"), unused(left, "hot")
    marked = right.where(F.col(count) > limit).select(*by, F.lit(True).alias(hot))
    left = left.join(F.broadcast(marked), by, "left").withColumn(salt, F.when(F.col(hot), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(0).cast("int")).drop(hot)
    parts = F.when(F.col(count) > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(right.withColumn(salt, F.explode(parts)).drop(count), [*by, salt]).drop(salt)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (u, v): one row (node, component) per node.

    component is the smallest node reachable. Alternating large-star and small-star
    passes, each written to the shared folder; a star's centre is joined to one row, so
    a node with very many neighbours costs no more than its neighbours' rows.
    Null ends and self loops are ignored; an empty input gives an empty result.
    """
    now = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"
    )
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        same = [
            x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (now, then)
        ]
        drop(now)
        now = then
        if same[0] == same[1]:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
