"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: ASCII white space, the only separators between words
WS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str, options: dict | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, so
    that a lost executor costs a re-read, and several readers share one computation.
    ``options``: of the writer."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, links: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of an undirected graph: ``nodes(id)``, ``links(a, b)`` to
    ``(id, component)`` with the smallest id of each component.

    Alternates large-star and small-star rounds (Kiveris et al., 2014): each is an
    aggregation by node with a map-side combine, and O(log n) rounds suffice whatever
    the shape of the graph. Stops when a round changes nothing; only that count goes
    to the driver."""
    e = staged(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{tag}-e"
    )
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # staged: a join of two plain exchanges is one whose large keys the engine can split
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{tag}-m")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large.where("u <> v"), f"{tag}-l")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}-n")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), f"{tag}-s")
        if e.exceptAll(nxt).isEmpty() and nxt.exceptAll(e).isEmpty():
            break
        e = nxt
    found = e.select(F.col("u").alias("id"), F.col("v").alias("_m"))
    return nodes.join(found, "id", "left").select("id", F.coalesce("_m", "id").alias("component"))


def row_key(id_col: str, text_col: str):
    """A 64-bit key of a row's id and text, to join derived rows back where ids may be
    null or repeated; rows with equal key are equal in both columns."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def running(numbers, chunk: int = 256):
    """Running totals of an array<bigint>, in two levels: appending to one array per
    chunk keeps the work linear for texts with very many matches or lines."""
    zero = F.lit(0).cast("bigint")

    def sums(a):
        start = F.struct(zero.alias("s"), F.array().cast("array<bigint>").alias("o"))
        step = lambda acc, x: F.struct((acc.s + x).alias("s"), F.concat(acc.o, F.array(acc.s + x)).alias("o"))
        return F.aggregate(a, start, step, lambda acc: acc.o)

    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(numbers) - 1) / chunk)).cast("int")),
        lambda c: sums(F.slice(numbers, c * chunk + 1, F.lit(chunk))),
    )
    ends = F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), zero))
    offsets = F.concat(F.array(zero), sums(ends))
    return F.flatten(F.zip_with(parts, F.slice(offsets, 1, F.size(parts)), lambda p, o: F.transform(p, lambda x: x + o)))


#: most keys that are broadcast to drop rows; beyond it an ordinary join does it
BROADCAST_KEYS = 500_000


def private(df: DataFrame) -> DataFrame:
    """``df`` with column names that no input can have, to join it without clashes."""
    mark = uuid.uuid4().hex
    return df.select([F.col(c).alias(f"{c}_{mark}") for c in df.columns])


def without(rows: DataFrame, on: list, keys: DataFrame) -> DataFrame:
    """The rows of ``rows`` whose values ``on`` (column expressions) equal no row of ``keys``
    (null equals null). The keys, narrow numbers or digests, are broadcast when counted few:
    then the rows, which may hold whole texts, are not shuffled."""
    keys = private(staged(keys.distinct(), "keys"))
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    same = [a.eqNullSafe(F.col(b)) for a, b in zip(on, keys.columns, strict=True)]
    return rows.join(F.broadcast(keys) if few else keys, same, "left_anti")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of at most ``rows`` rows for what is computed inside: a batch of whole
    texts is held by the JVM, outside its heap, and by the Python worker at the same time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Returns a task's freed memory to the system. Workers outlive their tasks and share an
    executor's memory with its JVM and with the tasks of later stages; without this each
    would hold on to the largest amount it ever used."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
