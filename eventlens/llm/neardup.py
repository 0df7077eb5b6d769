"""Near-duplicate documents by SetSketch registers, banded, estimated by likelihood, verified on full sets.

A document's set of word shingles is sketched by registers floor(1 - log_b x_i), x_i the least of exponential hashes of
its shingles: exponentially spaced truncated minima, mergeable by maximum. Documents with equal sets are one class from
the start. Bands of registers give buckets; each bucket is first checked as a star around its smallest member, and only
buckets that then still hold several components are compared inside, in blocks, by the joint likelihood of the register
order counts. Members of very large buckets meet by their rarest shingles instead, of which any two sets at the threshold
share one, so none of their pairs is left out. Every link is confirmed on full sets. With 32 bands of 4 registers a pair
at the threshold of 0.8 shares no band with probability (1 - 0.8^4)^32 < 1e-7.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, connected_components, forget, groups_of, keep, mix, table, tidy

M, BANDS, ROWS = 128, 32, 4
BASE, RATE, LEVELS = 1.001, 20.0, 65534
#: Members of one block of a bucket; members of buckets of more than HOT meet by their rarest shingles.
BLOCK, HOT = 512, 4096
#: Sets asked which shingles are common, and shingles held as such: they change how many sets meet, not which pairs are found.
ASKED, COMMON = 1000, 20_000
#: Bytes that a group's sets may take as bits; beyond it they are intersected as they are.
MOST_BITS = 64 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_A = (np.random.default_rng(20).integers(0, 1 << 31, M, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = np.random.default_rng(21).integers(0, 1 << 32, M, dtype=np.uint32)


def shingle_set(text: str | None, k: int, words: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; shorter texts are one shingle; none without words."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
    if len(words) > 400_000:
        words.clear()
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        acc = h[:n].copy()
        for j in range(1, k):
            acc = acc * _PRIME + h[j : j + n]
    return np.unique(mix(acc))


def registers(s: np.ndarray) -> np.ndarray:
    """M registers (uint16) of a set of 64-bit hashes."""
    least = np.full(M, 0xFFFFFFFF, np.uint32)
    low, high = s.astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(s), 2048):
        for off, x in ((0, low), (1, high)):
            v = _A[off::2, None] * x[None, i : i + 2048] + _B[off::2, None]
            np.minimum(least[off::2], v.min(axis=1), out=least[off::2])
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LEVELS + 1).astype(np.uint16)


_GRID = np.linspace(0.0, 1.0, 101)


def joint_estimate(ru: np.ndarray, rv: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of sets with known sizes from how many registers are larger, smaller, equal."""
    up, down = (ru > rv).sum(1), (ru < rv).sum(1)
    same = ru.shape[1] - up - down
    u, v = nu / (nu + nv), nv / (nu + nv)
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    p = lambda x: -np.log(1 - np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
    for j in _GRID:
        a, b = p(u - v * j), p(v - u * j)
        with np.errstate(divide="ignore"):
            ll = up * np.log(np.maximum(a, 1e-12)) + down * np.log(np.maximum(b, 1e-12)) + same * np.log(np.maximum(1 - a - b, 1e-12))
        ll = np.where(j <= np.minimum(u / v, v / u) + 1e-9, ll, -np.inf)
        at = np.where(ll > best, j, at)
        best = np.maximum(best, ll)
    return at


def _sketches(k: int):
    def run(batches):
        words = WordHash()
        for b in batches:
            n, f1, f2, sig = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, k, words)
                n.append(len(s))
                if len(s):
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    f1.append(int.from_bytes(d[:8], "little", signed=True))
                    f2.append(int.from_bytes(d[8:], "little", signed=True))
                    sig.append(registers(s).tobytes())
                else:
                    f1.append(None)
                    f2.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], names=["doc", "n", "f1", "f2", "sig"])

    return run


def _sets(k: int):
    def run(batches):
        words = WordHash()
        for b in batches:
            sets = [shingle_set(t, k, words).view(np.int64) for t in b.column(1).to_pylist()]
            at = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), flat)], names=["doc", "s"])

    return run


def _band_keys(sig: pd.Series) -> pd.Series:
    """Each sketch's band keys, the band's number mixed in."""
    r = np.stack([np.frombuffer(x, np.uint16) for x in sig]).reshape(len(sig), BANDS, ROWS).astype(np.uint64) if len(sig) else np.zeros((0, BANDS, ROWS), np.uint64)
    key = np.tile(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sig), 1))
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            key = mix(key * _PRIME + r[:, :, i])
    key = (key & ~np.uint64(BANDS - 1)) | np.arange(BANDS, dtype=np.uint64)  # the low bits name the band
    return pd.Series(list(key.view(np.int64)))


def _stars(batches):
    """Rows (key, rep) sorted: those of buckets with several members, with the bucket's first member in this range.

    The first and last key of a range may go on in its neighbours; their rows are emitted whatever their number.
    """
    held, first = None, True

    def rows(cols, edge):
        key, rep = cols
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(rep), pa.array(np.full(len(rep), rep[0])), pa.array(np.full(len(rep), edge))], names=["key", "rep", "center", "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, rep = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if held is not None:
            key, rep = np.r_[held[0], key], np.r_[held[1], rep]
        starts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
        held = key[starts[-1] :], rep[starts[-1] :]
        if first and len(starts) > 1:
            yield rows((key[: starts[1]], rep[: starts[1]]), True)
            first, starts = False, starts[1:]
        elif first:
            continue
        sizes = np.diff(starts)
        if (sizes > 1).any():
            of = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(starts[0], starts[-1])
            at, of = at[sizes[of] > 1], of[sizes[of] > 1]
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(rep[at]), pa.array(rep[starts[of]]), pa.array(np.zeros(len(at), bool))], names=["key", "rep", "center", "edge"])
    if held is not None:
        yield rows(held, True)


def _rarest(percent: int, common: np.ndarray, count: np.ndarray):
    """Rows (key, rep, comp) of each set's rarest shingles; common ones are given, sorted, with their counts.

    Sets of at least percent / 100 similarity share percent / 100 of either's shingles at least. In one order of all
    shingles the first that both have then stands among the first n - ceil(percent * n / 100) + 1 of each.
    """

    def run(batches):
        for b in batches:
            key = []
            for s in b.column(2).to_numpy(zero_copy_only=False):
                n = np.zeros(len(s), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    n = np.where(common[at] == s, count[at], 0)
                key.append(s[np.lexsort((s, n))[: len(s) + percent * len(s) // -100 + 1]])
            sizes = [len(x) for x in key]
            rep, comp = (np.repeat(b.column(i).to_numpy(), sizes) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key) if key else np.zeros(0, np.int64)), pa.array(rep), pa.array(comp)], names=["key", "rep", "comp"])

    return run


def _by_rarest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, bi, bj, band, block, rep, comp): members (rep, comp) dealt into blocks by each of their rarest shingles.

    The largest component of a key is compared with the rest of it and not with itself. Blocks are numbered below 0, so
    no group is taken for one of a bucket.
    """
    members = keep(members.distinct(), "members")
    own = sets.select(F.col("doc").alias("rep"), "s")
    few = members.select("rep").distinct().orderBy(F.xxhash64("rep"), "rep").limit(ASKED)
    common = own.join(few, "rep").select(F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "x").limit(COMMON).toArrow().sort_by("x")
    rarest = _rarest(percent, *(common[c].to_numpy() for c in ("x", "n")))
    met = keep(members.join(own, "rep").select("rep", "comp", "s").mapInArrow(tidy(rarest), "key long, rep long, comp long"), "large")
    of = met.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("size"), F.max(F.struct("m", "comp")).alias("main")).where("size > main.m")
    of = of.select("key", F.col("main.comp").alias("main"), F.ceil(F.expr("size - main.m") / BLOCK).alias("others"), F.ceil(F.col("main.m") / BLOCK).alias("mains"))
    met = met.join(of, "key").withColumn("block", F.expr("if(comp = main, others + pmod(xxhash64(rep), mains), pmod(xxhash64(rep), others))"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, others - 1 + if(comp = main, 0, mains))")))
    number = lambda x: (-1 - x).cast("int")
    return met.select("key", number(F.least("block", "other")).alias("bi"), number(F.greatest("block", "other")).alias("bj"), F.lit(-1).alias("band"), number(F.col("block")).alias("block"), "rep", "comp")


def _as_bits(sets: list[np.ndarray], most: int, stretch: int = 1 << 18) -> list[int]:
    """The sets as bits, one for each different member of any; none if they took more than most bytes.

    Members are gathered from stretches of sets, so no more is held than sets of that width have.
    """
    known, waiting, size = np.zeros(0, np.int64), [], 0
    for i, s in enumerate(sets):
        waiting.append(s)
        size += len(s)
        if size >= stretch or i == len(sets) - 1:
            known = np.unique(np.concatenate([known, *waiting]))
            waiting, size = [], 0
            if -(-len(known) // 8) * len(sets) > most:
                return []
    out = []
    for s in sets:
        row = np.zeros(-(-len(known) // 8) * 8, np.uint8)
        row[np.searchsorted(known, s)] = 1
        out.append(int.from_bytes(np.packbits(row).tobytes(), "big"))
    return out


def _block_links(cutoff: float, percent: int):
    """Links between different components in each (key, bi, bj) group, as few as join what belongs together.

    A pair is looked at in the first band it shares (band below 0: in every group that holds it). Likely pairs are verified on full sets, the likeliest first; pairs
    whose components have met by then are skipped, so a group emits fewer links than it has components.
    """

    def run(batches):
        for key, bi, bj, band, block, rep, comp, n, sig, sets in groups_of(batches, 3):
            r = np.stack([np.frombuffer(x, np.uint16) for x in sig])
            left, right = np.flatnonzero(block == bi[0]), np.flatnonzero(block == bj[0])
            found = []
            for i in left:
                j = right[(comp[right] != comp[i]) & ((right > i) | (bi[0] != bj[0]))]
                j = j[100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])]
                if len(j):
                    same = r[j] == r[i]
                    first = band[0] < 0 or same.reshape(len(j), BANDS, ROWS).all(2).argmax(1) == band[0]
                    j = j[first & (same.mean(1) >= cutoff - 0.05)]
                    found.append(np.stack([np.full(len(j), i), j], 1))
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            if not len(pairs):
                continue
            est = np.concatenate([joint_estimate(r[p[:, 0]], r[p[:, 1]], n[p[:, 0]].astype(float), n[p[:, 1]].astype(float)) for p in np.array_split(pairs, -(-len(pairs) // 20_000))])
            order = np.argsort(-est, kind="stable")
            pairs = pairs[order[: int((est >= cutoff).sum())]]
            used = np.unique(pairs)
            bits = dict(zip(used.tolist(), _as_bits([sets[i] for i in used], MOST_BITS)))
            root = {c: c for c in comp.tolist()}

            def find(c):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            out = []
            for i, j in pairs.tolist():
                a, b = find(int(comp[i])), find(int(comp[j]))
                if a != b:
                    inter = (bits[i] & bits[j]).bit_count() if bits else len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * inter >= percent * (int(n[i]) + int(n[j]) - inter):
                        root[max(a, b)] = min(a, b)
                        out.append((int(rep[i]), int(rep[j])))
            if out:
                u, v = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _likely(cutoff: float):
    def run(sa: pd.Series, sb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(sa):
            return pd.Series([], dtype=bool)
        ra, rb = (np.stack([np.frombuffer(x, np.uint16) for x in s]) for s in (sa, sb))
        return pd.Series(joint_estimate(ra, rb, na.to_numpy(float), nb.to_numpy(float)) >= cutoff)

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_shingles, component) for every row of docs with an id.

    component is the smallest id reachable by links of at least percent / 100 Jaccard similarity. Null, empty and
    blank texts have no shingles and are linked with nothing; equal sets are always linked; rows repeated with one id
    come back each with that id's component; rows with a null id are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cutoff = percent / 100 - 5 * np.sqrt(percent / 100 * (1 - percent / 100) / M)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sketched = keep(rows.mapInArrow(tidy(_sketches(k)), "doc long, n long, f1 long, f2 long, sig binary"), "sketches")
    classes = sketched.where("f1 is not null").groupBy("f1", "f2").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = keep(classes, "classes")
    reps = classes.select("rep", "n", "sig")
    keyed = reps.select("rep", F.explode(F.pandas_udf(_band_keys, "array<long>")("sig")).alias("key")).select("key", "rep")
    ranged = keyed.repartitionByRange(parts, "key", "rep").sortWithinPartitions("key", "rep")
    buckets = keep(ranged.mapInArrow(tidy(_stars), "key long, rep long, center long, edge boolean"), "buckets")
    # the parts of a bucket that spans ranges meet through the smallest of their centers
    heads = buckets.where("edge").select("key", "center").distinct()
    tops = heads.groupBy("key").agg(F.min("center").alias("a"))
    spans = heads.join(tops, "key").where("center <> a").select("a", F.col("center").alias("b"))
    stars = buckets.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).unionByName(spans)
    pairs = keep(_filtered(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), reps, cutoff, percent), "pairs")
    # full sets of the documents that have company in a bucket
    wanted = buckets.where("rep <> center").select(F.col("rep").alias("doc")).unionByName(buckets.where("rep <> center").select(F.col("center").alias("doc"))).unionByName(spans.select(F.col("a").alias("doc"))).unionByName(spans.select(F.col("b").alias("doc")))
    sets = keep(rows.join(wanted.distinct(), "doc", "left_semi").dropDuplicates(["doc", "text"]).mapInArrow(tidy(_sets(k)), "doc long, s array<long>"), "sets")
    links = keep(_verified(pairs, sets, percent), "links")
    comps = keep(connected_components(links), "comps")
    # buckets that still hold several components, and more than the two members of a checked pair
    inside = buckets.select("key", "rep").distinct().join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    several = lambda df: df.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi and size > 2").select("key", "size")
    mixed = keep(several(inside), "mixed")
    rest = inside.join(mixed.where(F.col("size") <= HOT), "key").withColumn("band", F.expr(f"cast(key & {BANDS - 1} as int)"))
    rest = rest.withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.expr("cast(pmod(xxhash64(rep), nb) as int)"))
    rest = rest.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).select("key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "band", "block", "rep", "comp")
    hot = mixed.where(F.col("size") > HOT).select("key")
    if hot.limit(1).count():
        rest = rest.unionByName(_by_rarest(inside.join(hot, "key").select("rep", "comp"), sets, percent))
    whole = reps.join(sets.select(F.col("doc").alias("rep"), "s"), "rep")
    rest = rest.join(whole, "rep").select("key", "bi", "bj", "band", "block", "rep", "comp", "n", "sig", "s")
    dealt = rest.repartition(parts, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    late = keep(dealt.mapInArrow(tidy(_block_links(cutoff, percent)), "u long, v long"), "links")
    if late.limit(1).count():
        comps = keep(connected_components(links.unionByName(late)), "comps")
    forget(buckets, pairs, sets, late, links)
    by_class = classes.select("f1", "f2", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = sketched.select("doc", "n", "f1", "f2").join(by_class, ["f1", "f2"], "left").select("doc", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component"))
    return out


def _filtered(pairs: DataFrame, reps: DataFrame, cutoff: float, percent: int) -> DataFrame:
    a = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return both.where(F.pandas_udf(_likely(cutoff), "boolean")("sa", "sb", "na", "nb")).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a, b = sets.select(F.col("doc").alias("a"), F.col("s").alias("x")), sets.select(F.col("doc").alias("b"), F.col("s").alias("y"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("i"))
    return both.where(100 * F.col("i") >= percent * (F.col("nx") + F.col("ny") - F.col("i"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near duplicates: of each component the rows with its smallest id stay.

    Rows with a null id stay. All columns come back as they are, clashing names included.
    """
    found = near_duplicates(docs, k, percent, id_col, text_col)
    gone = found.where("doc <> component").select(F.col("doc").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept by sets of 4-word shingles at 80 percent."""
    found = near_duplicates(table(spark, sf_dir, "documents"), k=4)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach AS (
  SELECT doc_id AS d, doc_id AS c FROM documents
  UNION SELECT links.v, reach.c FROM reach JOIN links ON links.u = reach.d)
SELECT d AS doc_id, coalesce(max(n), 0) AS n_shingles, min(c) AS component_id, d = min(c) AS kept
FROM reach LEFT JOIN sizes ON sizes.doc_id = d GROUP BY d
"""
