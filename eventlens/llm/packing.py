"""Best-fit packing by exact complements, planned on the histogram of lengths.

What fits together depends on lengths alone, and there are at most `size` of them: the array of counts by length is the
index. A gap's exact complement of one length is a look-up in it, of two lengths a look-up for each first one, of three
for each first two; no table of sums is built beside it. So the driver plans patterns of
lengths with multiplicities from the histogram (at most `size` rows whatever the corpus), and each piece finds its place
from its length and its rank among pieces of that length; no bin is looked for by row. Then the pieces' ids travel to
their sequences, and write_sequences() writes one list of ids a sequence, with the pieces it is made of.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, keep, new_path, table, task_id
from .tokens import END_ID, encoder, in_small_batches, tokenizer_path

SIZE = 4096
#: Rows (task, length, offset; 20 bytes each) that are sent to all tasks at most.
MOST_BROADCAST = 2_000_000


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, times used) that place every piece; the lengths of a pattern add up to size at most.

    Longest first, each length looks up its exact complement among single lengths, sums of two and sums of three, and
    uses it as often as the counts allow. Lengths without an exact complement go best fit, longest first, into the
    open pattern with the least room that takes them.
    """
    left = np.zeros(size + 1, np.int64)
    for n, c in histogram.items():
        left[n] += c
    done: list[tuple[tuple[int, ...], int]] = []
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def use(lengths: tuple[int, ...]) -> int:
        need: dict[int, int] = {}
        for n in lengths:
            need[n] = need.get(n, 0) + 1
        return min(int(left[n]) // k for n, k in need.items())

    def pair(gap: int, top: int):
        """a >= b with a + b = gap, a <= top, both there; the largest a."""
        if gap < 2:
            return
        low, high = (gap + 1) // 2, min(gap - 1, top)
        if high < low:
            return
        a = np.arange(high, low - 1, -1)
        for x in a[(left[a] > 0) & (left[gap - a] > 0)]:
            yield int(x), gap - int(x)

    def complements(n: int):
        gap = size - n
        if gap and left[gap]:
            yield (gap,)
        for p in pair(gap, n):
            yield p
        tops = np.flatnonzero(left[1 : max(1, min(gap - 1, n + 1))] > 0)[::-1] + 1
        for a in map(int, tops):
            if a * 3 < gap:
                break
            for p in pair(gap - a, a):
                yield (a, *p)
                break

    residual: dict[int, int] = {}
    for n in range(size, 0, -1):
        if not left[n]:
            continue
        if n == size:
            done.append(((n,), int(left[n])))
            left[n] = 0
            continue
        while left[n]:
            for c in complements(n):
                if times := use((n, *c)):
                    for x in (n, *c):
                        left[x] -= times
                    done.append(((n, *c), times))
                    break
            else:
                residual[n], left[n] = int(left[n]), 0
    def put(lengths: tuple[int, ...], times: int) -> None:
        room = size - sum(lengths)
        if not room:
            done.append((lengths, times))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((lengths, times))

    for n, count in sorted(residual.items(), reverse=True):
        while count:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                each = min(size // n, count)
                put((n,) * each, count // each)
                count -= each * (count // each)
                continue
            room = rooms[i]
            lengths, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            used = min(times, count)
            if times > used:
                put(lengths, times - used)
            put((*lengths, n), used)
            count -= used
    return done + [x for room in rooms for x in open_[room]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: key (length, first rank), first sequence, offset; sorted by key."""
    rows, taken, sequence = [], {}, 0
    for lengths, times in patterns:
        at = 0
        for n in lengths:
            rank = taken.get(n, 0)
            rows.append(((n << 44) | rank, sequence, at))
            taken[n] = rank + times
            at += n
        sequence += times
    rows.sort()
    cols = list(zip(*rows)) or [(), (), ()]
    return {k: np.array(v, np.int64) for k, v in zip(("key", "sequence", "offset"), cols)}


def _cut(path: str, size: int, end_id: int):
    """Pieces of each text with their ids, the task's number and the rank among the task's pieces of that length.

    Ids are bytes, two an id where that is enough for all of the piece, else four.
    """

    def run(batches):
        enc, part, seen = encoder(path), task_id(), np.zeros(size + 1, np.int64)
        for b in in_small_batches(batches, 1):
            out = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1))):
                ids = np.append(ids, np.uint32(end_id))
                for piece, start in enumerate(range(0, len(ids), size)):
                    x = ids[start : start + size]
                    out.append((doc, piece, start, len(x), x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes(), part, int(seen[len(x)])))
                    seen[len(x)] += 1
            cols = list(zip(*out)) or [()] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids", "part", "rank"])

    return run


_PIECE = "doc_id long, piece int, start long, length long, offset long"
_SEQUENCE = f"sequence_id long, ids array<int>, pieces array<struct<{_PIECE.replace(' ', ':').replace(',:', ',')}>>"


def _sequence_rows(b: pa.RecordBatch) -> pa.RecordBatch:
    """Sequences of whole runs of pieces, which are sorted by sequence and offset."""
    seq, length, offset = (b.column(k).to_numpy() for k in ("sequence_id", "length", "offset"))
    first = np.r_[0, np.flatnonzero(np.diff(seq)) + 1]
    ends = np.cumsum(length)
    if (ends - length - np.repeat((ends - length)[first], np.diff(np.r_[first, len(seq)])) != offset).any():
        raise ValueError("pieces don't tile their sequence")
    flat = np.concatenate([np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype(np.int32) for x, n in zip(b.column("ids").to_pylist(), length)])
    names = ["doc_id", "piece", "start", "length", "offset"]
    ids = pa.ListArray.from_arrays(pa.array(np.r_[(ends - length)[first], len(flat)].astype(np.int32)), pa.array(flat))
    pieces = pa.ListArray.from_arrays(pa.array(np.r_[first, len(seq)].astype(np.int32)), pa.StructArray.from_arrays([b.column(k) for k in names], names))
    return pa.RecordBatch.from_arrays([pa.array(seq[first]), ids, pieces], names=["sequence_id", "ids", "pieces"])


def _sequences(batches):
    """Holds one sequence from batch to batch."""
    encoder.cache_clear()  # all texts are encoded by now
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        seq = b.column("sequence_id").to_numpy()
        cut = int(np.searchsorted(seq, seq[-1]))
        held = b.slice(cut)
        if cut:
            yield _sequence_rows(b.slice(0, cut))
    if held is not None:
        yield _sequence_rows(held)


def write_sequences(docs: DataFrame, path: str, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes sequence_id, ids (at most size of them) and pieces: doc_id, piece, start, length, offset of each piece in ids.

    Null and empty texts are the end id alone; rows repeated with one id are packed each; null ids are kept; an empty
    table gives files without rows. Only documents of more than size tokens are cut.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = keep(rows.mapInArrow(_cut(tokenizer or tokenizer_path(), size, end_id), "doc_id long, piece int, start long, length long, ids binary, part int, rank long"), "pieces")
    counts = keep(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    # at most `size` rows reach the driver
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    at = spark.sparkContext.broadcast(slots(plan(histogram, size)))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s = at.value
        key = (length.to_numpy(np.int64) << 44) | rank.to_numpy(np.int64)
        i = np.searchsorted(s["key"], key, "right") - 1
        return pd.DataFrame({"sequence_id": s["sequence"][i] + key - s["key"][i], "offset": s["offset"][i]})

    # beyond a checked number of rows the pieces are shuffled to it instead
    ranked = pieces.join(F.broadcast(before) if counts.count() <= MOST_BROADCAST else before, ["part", "length"])
    placed = ranked.withColumn("at", F.pandas_udf(place, "sequence_id long, offset long")("length", F.col("before") + F.col("rank")))
    moved = placed.select("at.sequence_id", "at.offset", "doc_id", "piece", "start", "length", "ids").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    moved.mapInArrow(_sequences, _SEQUENCE).write.option("compression", "zstd").parquet(path)
    forget(pieces, counts)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SEQUENCE).parquet(path)


def _written_pieces(batches):
    encoder.cache_clear()
    for b in batches:
        ids, pieces = b.column(1), b.column(2)
        n = np.diff(pieces.offsets.to_numpy())
        flat, all_ = ids.values.to_numpy().astype("<u4"), pieces.flatten()
        doc, piece, start, length, offset = (all_.field(i) for i in range(5))
        at = np.repeat(ids.offsets.to_numpy()[:-1].astype(np.int64), n) + offset.to_numpy()
        crc = np.array([zlib.crc32(flat[i : i + k].tobytes()) for i, k in zip(at, length.to_numpy())], np.int64)
        cols = [doc, piece, start, length, pa.array(crc), pa.array(np.repeat(b.column(0).to_numpy(), n)), offset]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece, read from the sequences that write_sequences() wrote."""
    path = new_path(docs.sparkSession, "sequences")
    write_sequences(docs, path, tokenizer, size, end_id, id_col, text_col)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return read_sequences(docs.sparkSession, path).mapInArrow(_written_pieces, schema)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in the sequences."""
    return pack(table(spark, sf_dir, "documents"))
