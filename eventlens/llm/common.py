"""Helpers shared by the training-data operators: shared storage, hashing, connected components."""

from __future__ import annotations

import ctypes
import re
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it.
BLANKS = " \t\n\x0b\x0c\r"
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or (unset, as in tests) one under the warehouse.

    A cluster whose setting is missing and whose warehouse is a local folder of the driver is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        if not spark.sparkContext.master.startswith("local") and (at.startswith(("file:", "/")) or "://" not in at):
            raise ValueError("spark.checkpoint.dir is not set, and the warehouse is a local folder")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df to the shared folder and rereads it: lineage ends there, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def forget(*frames: DataFrame) -> None:
    """Deletes tables that keep() wrote and nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_kept_at", None):
            _delete(df.sparkSession, path)


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end what keep() wrote inside it, but for the frames that were given to the yielded function."""
    own: list[str] = []
    spared: set[str] = set()
    _SCOPES.append(own)
    try:
        yield lambda *frames: spared.update(f._kept_at for f in frames)
    finally:
        _SCOPES.pop()
        for path in own:
            if path not in spared:
                _delete(spark, path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows: texts are long, and a worker holds a batch several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def task_id() -> int:
    return TaskContext.get().partitionId()


def tidy(run):
    """run, a function of batches; at its end the worker gives freed memory back, as idle workers count against their executor."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, vectorised."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def unused(df: DataFrame, name: str) -> str:
    """name, or it with underscores after it, as no column of df is named."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offsets_of(sizes: DataFrame, key: str, n: str, name: str, chunk: int = 10_000) -> DataFrame:
    """(key, name): the sum of n over all smaller keys, which are distinct whole numbers from 0, in two levels.

    One task sees one chunk of keys, or one row a chunk.
    """
    own = sizes.select(F.col(key), F.col(n).alias("__n"), F.floor(F.col(key) / chunk).alias("__chunk"))
    totals = own.groupBy("__chunk").agg(F.sum("__n").alias("__t"))
    before = totals.select("__chunk", (F.sum("__t").over(Window.orderBy("__chunk")) - F.col("__t")).alias("__b"))
    local = F.sum("__n").over(Window.partitionBy("__chunk").orderBy(key)) - F.col("__n")
    return own.withColumn("__l", local).join(before, "__chunk").select(key, (F.col("__b") + F.col("__l")).alias(name))


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 60) -> DataFrame:
    """Components of undirected edges of longs: rows (node, component), component the smallest node reachable.

    Alternating large-star and small-star rounds; each is one partial aggregate and one equi-join that AQE may split,
    so a hub costs no single task its whole neighbourhood, and nothing but a count and a checksum reaches the driver.
    Null ends, loops and repeated edges are ignored; no edges give an empty result.
    """
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
    e = keep(e.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    sign = e.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(20,0)))")).first()
    for _ in range(most_rounds):
        if not sign[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = keep(large.distinct(), "cc")
        m = _least(large)
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = keep(small.unionByName(m.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
        now = small.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(20,0)))")).first()
        forget(e, large)
        e, sign, before = small, now, sign
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


class WordHash(dict):
    """Word (bytes) -> 64-bit hash, remembered; emptied by clear() when it has grown."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def groups_of(batches, n_keys: int):
    """Streams record batches sorted by their first n_keys columns as one list of columns a group; holds one group."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols)]
        change = np.zeros(len(cols[0]) - 1, bool)
        for c in cols[:n_keys]:
            change |= c[1:] != c[:-1]
        starts = np.r_[0, np.flatnonzero(change) + 1]
        for i, j in zip(starts[:-1], starts[1:]):
            yield [c[i:j] for c in cols]
        carry = [c[starts[-1] :] for c in cols]
    if carry is not None:
        yield carry
