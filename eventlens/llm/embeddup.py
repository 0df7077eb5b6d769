"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors.

A vector's code is the signs of its projections on stacked random rotations. Slices of the code are the keys of hash
tables that propose pairs. From a code, its correction factor f and its residual ratio r, the inner product with another
vector is estimated without bias, and its error is at most r * sqrt(1 - cos^2); so a pair whose upper bound is under the
threshold needs no exact product. Only vectors with a surviving partner are sent on for exact recomputation in double
precision. Pairs are counted and joined inside the tasks: what they emit is linear in the vectors, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, forget, groups_of, keep, mix, table

#: Chance that a pair at the threshold shares no table.
MISS = 1e-5
#: Vectors a bucket holds on average, and members of one block of a bucket.
PER_BUCKET, BLOCK = 32, 512


def table_shape(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a key, tables) for n vectors: buckets stay PER_BUCKET on average, pairs at the threshold are missed with MISS."""
    bits = max(4, math.ceil(math.log2(max(2, n) / PER_BUCKET)) if n > PER_BUCKET else 4)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-same))


def projections(dim: int, bits: int, seed: int = 3) -> np.ndarray:
    """bits (or more, to a multiple of dim) rows: stacked random rotations, scaled so that P'P is the identity."""
    rng = np.random.default_rng([seed, dim])
    turns = -(-bits // dim)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(turns)]) / math.sqrt(turns)


def encode(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits (n, rows of p), correction factor f and residual ratio r of unit vectors x."""
    up = (x @ p.T) >= 0
    z = decode(up, p)
    f = np.maximum(np.einsum("ij,ij->i", z, x), 1e-9)
    rest = np.sqrt(np.maximum(np.einsum("ij,ij->i", z, z) - f * f, 0))
    return up, f, rest / f


def decode(up: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.where(up, 1.0, -1.0) @ p / math.sqrt(len(p))


def _clean(column) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for null, zero, empty, or with null or non-finite components."""
    out = []
    for v in column.to_pylist():
        x = None if not v or any(c is None for c in v) else np.array(v, np.float64)
        if x is not None:
            with np.errstate(over="ignore", invalid="ignore"):
                top = np.abs(x).max()
                x = x / np.linalg.norm(x / top) / top if np.isfinite(top) and top > 0 else None
        out.append(x)
    return out


def _codes(bits: int, tables: int):
    def run(batches):
        made: dict[int, np.ndarray] = {}
        for b in batches:
            ids, xs = b.column(0).to_pylist(), _clean(b.column(1))
            rows = []
            for dim in sorted({len(x) for x in xs if x is not None}):
                p = made.setdefault(dim, projections(dim, bits * tables))
                at = [i for i, x in enumerate(xs) if x is not None and len(x) == dim]
                x = np.stack([xs[i] for i in at])
                up, f, r = encode(x, p)
                scale = np.abs(x).max(1) / 127
                q = np.round(x / scale[:, None]).astype(np.int8)
                weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    key = (up[:, : bits * tables].reshape(len(at), tables, bits) * weights).sum(2, dtype=np.uint64)
                    key = mix(key + mix(np.arange(1, tables + 1, dtype=np.uint64) + np.uint64(dim << 20))).view(np.int64)
                packed = np.packbits(up, axis=1)
                rows += [(ids[i], packed[k].tobytes(), q[k].tobytes(), float(f[k]), float(r[k]), float(scale[k]), key[k].tolist()) for k, i in enumerate(at)]
            cols = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["vec", "code", "q", "f", "r", "scale", "keys"])

    return run


def _bounds(code, q, f, r, scale, made, bits, threshold):
    """(n, n) whether the upper bound of the inner product of i (by its code) and j (by its small integers) reaches the threshold."""
    dim = len(q[0])
    p = made.setdefault(dim, projections(dim, bits))
    up = np.unpackbits(np.stack([np.frombuffer(c, np.uint8) for c in code]), axis=1)[:, : len(p)].astype(bool)
    z = decode(up, p) / f[:, None]
    y = np.stack([np.frombuffer(v, np.int8) for v in q]) * scale[:, None]
    slack = r * math.sqrt(1 - threshold * threshold)
    rounding = np.sqrt(1 + r * r)[:, None] * (scale * math.sqrt(dim) / 2)[None, :]
    return z @ y.T + slack[:, None] + rounding >= threshold - 1e-9, up


def _sides(block, bi, bj):
    return np.flatnonzero(block == bi), np.flatnonzero(block == bj)


def _survivors(bits: int, threshold: float):
    """Of each (key, bi, bj) group, the members with a partner whose upper bound reaches the threshold."""

    def run(batches):
        made: dict = {}
        for key, bi, bj, block, vec, code, q, f, r, scale in groups_of(batches, 3):
            likely, _ = _bounds(code, q, f, r, scale, made, bits, threshold)
            np.fill_diagonal(likely, False)
            if bi[0] != bj[0]:
                likely &= (block[:, None] != block[None, :])
            hit = likely.any(1) | likely.any(0)
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (key, bi, bj, block, vec)], names=["key", "bi", "bj", "block", "vec"])

    return run


def _exact(bits: int, key_bits: int, threshold: float):
    """Links of each group that no earlier table has: (vec, links, root), root the vector's root among the group's links."""

    def run(batches):
        made: dict = {}
        for key, bi, bj, block, vec, code, q, f, r, scale, copies, keys, x in groups_of(batches, 3):
            likely, _ = _bounds(code, q, f, r, scale, made, bits, threshold)
            vectors = np.stack([np.asarray(v, np.float64) for v in x])
            vectors /= np.abs(vectors).max(1, keepdims=True)
            vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
            all_keys = np.stack([np.asarray(k) for k in keys])
            own = int(np.flatnonzero(all_keys[0] == key[0])[0])
            left, right = _sides(block, bi[0], bj[0])
            links, root = np.zeros(len(vec), np.int64), np.arange(len(vec))

            def find(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i in left:
                j = right[right > i] if bi[0] == bj[0] else right
                j = j[likely[i, j] | likely[j, i]]
                if len(j) and own:
                    j = j[~(all_keys[j, :own] == all_keys[i, :own]).any(1)]
                if len(j):
                    j = j[vectors[j] @ vectors[i] >= threshold]
                if len(j):
                    links[i] += copies[j].sum()
                    links[j] += copies[i]
                    for k in j:
                        a, b = find(i), find(k)
                        if a != b:
                            root[max(a, b)] = min(a, b)
            hit = np.flatnonzero(links)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(vec[hit]), pa.array(links[hit]), pa.array(vec[[find(i) for i in hit]])], names=["vec", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id) of every id.

    Vectors that are null, empty, zero or hold null or non-finite components are linked with nothing; so are vectors of
    different lengths. Rows repeated with one id are one vector (of different ones the one with the least hash); rows
    with a null id are left out; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec"), F.col(vec_col).cast("array<double>").alias("x"))
    rows = keep(rows.groupBy("vec").agg(F.min_by("x", F.xxhash64("x")).alias("x")), "vectors")
    same = rows.where("x is not null").groupBy(F.xxhash64(F.lit(5), "x").alias("h1"), F.xxhash64(F.lit(9), "x").alias("h2"))
    classes = keep(same.agg(F.min("vec").alias("rep"), F.count("*").alias("copies"), F.first("x").alias("x")), "classes")
    n = classes.count()
    key_bits, tables = table_shape(n, threshold)
    bits = key_bits * tables
    coded = keep(classes.select("rep", "x").mapInArrow(_codes(key_bits, tables), "vec long, code binary, q binary, f double, r double, scale double, keys array<long>"), "codes")
    small = coded.select("vec", "code", "q", "f", "r", "scale")
    keyed = coded.select("vec", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    member = keyed.join(sizes, "key").withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.expr("cast(pmod(xxhash64(vec), nb) as int)"))
    member = member.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).select("key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "vec")
    dealt = lambda df: df.repartition(parts, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "vec")
    first = dealt(member.join(small, "vec").select("key", "bi", "bj", "block", "vec", "code", "q", "f", "r", "scale"))
    alive = keep(first.mapInArrow(_survivors(bits, threshold), "key long, bi int, bj int, block int, vec long"), "alive")
    whole = coded.join(classes.select(F.col("rep").alias("vec"), "copies", "x"), "vec")
    second = dealt(alive.join(whole, "vec").select("key", "bi", "bj", "block", "vec", "code", "q", "f", "r", "scale", "copies", "keys", "x"))
    linked = keep(second.mapInArrow(_exact(bits, key_bits, threshold), "vec long, links long, root long"), "linked")
    comps = connected_components(linked, "vec", "root").withColumnRenamed("node", "rep")
    counts = linked.groupBy(F.col("vec").alias("rep")).agg(F.sum("links").alias("links"))
    # invalid vectors are classes too, without a code: their copies are linked with nothing
    valid = coded.select(F.col("vec").alias("rep"), F.lit(True).alias("valid"))
    by_class = classes.select("h1", "h2", "rep", "copies").join(valid, "rep").join(counts, "rep", "left").join(comps, "rep", "left")
    by_class = by_class.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    forget(alive)
    keyed_rows = rows.select("vec", F.xxhash64(F.lit(5), "x").alias("h1"), F.xxhash64(F.lit(9), "x").alias("h2"))
    out = keyed_rows.join(by_class, ["h1", "h2"], "left")
    return out.select(F.col("vec").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec").alias("component_id"))


def op10_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id AS d, vec_id AS c FROM embeddings
  UNION SELECT links.v, reach.c FROM reach JOIN links ON links.u = reach.d),
comp AS (SELECT d, min(c) AS c FROM reach GROUP BY d),
degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT d AS vec_id, coalesce(n, 0) AS n_links, c AS component_id, d = c AS kept
FROM comp LEFT JOIN degree ON u = d
"""
