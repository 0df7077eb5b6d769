"""Line dedup by sorted hash ranges.

Lines travel as 128-bit hashes with (document, position), never as text. One range exchange on (hash, document
descending, position) orders them; each task streams its range and settles every key that lies wholly inside it. A key
at the edge of a range may go on in the next one (a hot line fills many ranges), so its rows are emitted as open and
settled by a second, small aggregate over the edge keys: at most two keys a range. What comes back is one compressed
bitmap for each document that loses lines; texts are never shuffled by line.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, keep, table

_NAMES = ["h1", "h2", "doc", "tag", "pos"]
_OUT = "h1 long, h2 long, doc long, tag long, pos int, open boolean"


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(h1, h2, doc, tag, pos) of each line whose key has min_chars code points; tag tells texts of a repeated id apart."""
    lines = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("tag"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc", "tag", "pos", ascii_lower(F.trim("line", F.lit(BLANKS))).alias("key")).where(F.length("key") >= min_chars)
    return keys.select(F.xxhash64(F.lit(11), "key").alias("h1"), F.xxhash64(F.lit(23), "key").alias("h2"), "doc", "tag", "pos")


def _settle(min_docs: int):
    def run(batches):
        carry, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols)]
            h1, h2, doc = cols[:3]
            starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            last = starts[-1]
            carry = [c[last:] for c in cols]
            if first and last > 0:
                end = starts[1]
                yield _rows([c[:end] for c in cols], True)
                cols, starts, first = [c[end:last] for c in cols], starts[1:-1] - end, False
            elif not first:
                cols, starts = [c[:last] for c in cols], starts[:-1]
            else:
                continue
            if len(starts):
                doc = cols[2]
                key = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(doc)]))
                new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
                drop = (np.bincount(key, weights=new)[key] >= min_docs) & (doc != doc[starts][key])
                if drop.any():
                    yield _rows([c[drop] for c in cols], False)
        if carry is not None:
            yield _rows(carry, True)

    return run


def _rows(cols, is_open):
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.full(len(cols[0]), is_open))], names=[*_NAMES, "open"])


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, tag, pos) of the lines that go: key in min_docs documents or more, and not the largest of them."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("tag"), F.col("pos")]
    keys = line_keys(docs.where(F.col(id_col).isNotNull()), id_col, text_col, min_chars)
    ranged = keys.repartitionByRange(n, *order).sortWithinPartitions(*order)
    settled = keep(ranged.mapInArrow(_settle(min_docs), _OUT), "lines")
    edge = settled.where("open")
    docs_of = edge.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("top"))
    # at most two edge keys a range, so this side is bounded by the number of partitions, not by the data
    late = edge.join(F.broadcast(docs_of.where(F.col("n") >= min_docs)), ["h1", "h2"]).where("doc <> top")
    return settled.where("not open").select("doc", "tag", "pos").unionByName(late.select("doc", "tag", "pos"))


def _bitmap(positions: pd.Series) -> pd.Series:
    def pack(p):
        bits = np.ones(-(-(int(max(p)) + 1) // 8) * 8, np.uint8)
        bits[np.asarray(p)] = 0
        return zlib.compress(np.packbits(bits).tobytes(), 1)

    return positions.map(pack)


def keep_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """(doc, tag, keep): for each document that loses lines, a compressed bitmap; lines beyond its end stay."""
    return dropped_lines(docs, **options).groupBy("doc", "tag").agg(F.collect_list("pos").alias("p")).select("doc", "tag", F.pandas_udf(_bitmap, "binary")("p").alias("keep"))


def kept_lines(text: str, bitmap: bytes | None) -> tuple[list[str], int]:
    """The lines of text that the bitmap keeps, and how many it drops."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return lines, 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    kept = [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]
    return kept, len(lines) - len(kept)


def _with_bitmaps(docs: DataFrame, id_col: str, text_col: str, columns: list[str], **options) -> DataFrame:
    own = docs.select(*columns, F.col(id_col).cast("long").alias("__doc"), F.xxhash64(text_col).alias("__tag"))
    maps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, **options).select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.col("keep").alias("__keep"))
    return own.join(maps, ["__doc", "__tag"], "left")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with repeated lines taken out of text_col; all other columns, clashing names included, stay as they are.

    Null text stays null; an empty text has one empty line; rows without an id lose nothing and count nowhere; rows
    repeated with one id are one document; a document may end empty.
    """

    @F.pandas_udf("string")
    def apply(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        return pd.Series([t if b is None else "\n".join(kept_lines(t, b)[0]) for t, b in zip(text, bitmap)], dtype=object)

    joined = _with_bitmaps(docs, id_col, text_col, docs.columns, **options)
    text = F.when(F.col("__keep").isNull(), F.col(text_col)).otherwise(apply(text_col, "__keep"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""

    @F.pandas_udf("n_dropped long, kept_sha256 string")
    def digest(text: pd.Series, bitmap: pd.Series) -> pd.DataFrame:
        rows = [kept_lines(t, b) for t, b in zip(text, bitmap)]
        return pd.DataFrame({"n_dropped": [n for _, n in rows], "kept_sha256": [hashlib.sha256("\n".join(k).encode()).hexdigest() for k, _ in rows]})

    joined = _with_bitmaps(table(spark, sf_dir, "documents"), "doc_id", "text", ["doc_id", "text"])
    text = F.coalesce("text", F.lit(""))
    out = joined.select("doc_id", F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"), digest("text", "__keep").alias("d"))
    return out.select("doc_id", "n_lines", "d.n_dropped", "d.kept_sha256")


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
hot AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, hot.top IS NOT NULL AND doc_id <> hot.top AS gone FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
