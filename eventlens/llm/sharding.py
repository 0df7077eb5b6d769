"""Global shuffle into shards: two passes, native expressions only.

write_shards() moves the records. Pass 1 scatters whole records over buckets of a few MB by a seeded hash of what they
carry; pass 2 orders each bucket by another seeded hash, which is a uniform permutation as Fisher-Yates' is, but one that
depends on the seed and the records alone, not on tasks, and writes its records straight to their shards. The place of a
record in the whole order is its bucket's offset plus its place in the bucket, and records are dealt to shards round
robin, so shard sizes differ by one at most (law `rows`). Records cross the network once. Copies of a record that is
common are numbered first, and the number is hashed with it, so no bucket holds them all.

assign_shards() gives places alone, from an id and a few numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .common import forget, keep, new_path, offsets_of, table

#: Records a bucket holds on average: some tens of bytes each, so a bucket is a few hundred kB wherever it is shuffled.
BUCKET_ROWS = 4096
#: Rows of one record that are numbered at a time.
_RUN = 65_536
#: Bytes of records that a bucket of write_shards() holds on average.
BUCKET_BYTES = 1 << 20


def assign_shards(docs: DataFrame, carried: list[str], n_shards: int = 8, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The carried columns, copy, shard and slot: the place of every row. Slots are gapless from 0 in each shard.

    Rows alike in all carried columns, nulls included, each get a place of their own: `copy` numbers them. An empty table
    gives an empty result.
    """
    groups = docs.groupBy(*carried).agg(F.count("*").alias("__n"))
    # numbered in runs, so that a record with very many copies needs no array of them all
    runs = groups.select(*carried, "__n", F.explode(F.expr(f"sequence(0L, __n - 1, {_RUN}L)")).alias("__from"))
    rows = runs.select(*carried, F.explode(F.expr(f"sequence(__from, least(__from + {_RUN}, __n) - 1)")).alias("copy"))
    n = max(1, -(-docs.count() // bucket_rows))
    record = [*carried, "copy"]
    bucket = F.pmod(F.xxhash64(F.lit(seed), *record), F.lit(n)).cast("long")
    drawn = F.xxhash64(F.lit(seed + 1), *record).alias("__drawn")
    each = rows.withColumn("bucket", bucket).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct(drawn, *record))).alias("members"))
    dealt = keep(each, "shuffled")
    sizes = dealt.select("bucket", F.size("members").alias("n"))
    before = offsets_of(sizes, "bucket", "n", "before")
    at = dealt.join(before, "bucket").select("before", F.posexplode("members").alias("pos", "m"))
    place = F.col("before") + F.col("pos")
    return at.select(*[f"m.{c}" for c in record], (place % n_shards).cast("int").alias("shard"), F.floor(place / n_shards).cast("long").alias("slot"))


def _bytes(docs: DataFrame):
    """About the bytes of a record."""
    each = {"string": "octet_length(`{}`)", "binary": "octet_length(`{}`)"}
    wide = ("array", "map", "struct")
    sizes = [each.get(t, "octet_length(cast(`{}` as string))" if t.startswith(wide) else "8").format(c.replace("`", "``")) for c, t in docs.dtypes]
    return F.expr(" + ".join(f"coalesce({x}, 0)" for x in sizes)).cast("long")


#: A record is common if it is more than this share of all rows, so there are no more common ones than its inverse.
COMMON = 1 / 1000


def _copies_numbered(records: DataFrame, key, n_rows: int, name: str) -> DataFrame:
    """records with a number of the copy: 0, 1, ... for rows of common records, 0 for all others."""
    most = max(1000, int(n_rows * COMMON))
    hot = [r[0] for r in records.groupBy(key.alias("k")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("k").collect()]  # 1 / COMMON at most
    if not hot:
        return records.withColumn(name, F.lit(0).cast("long"))
    is_hot = key.isin(hot)
    groups = records.where(is_hot).groupBy(*[F.col(f"`{c}`") for c in records.columns]).agg(F.count("*").alias("__n"))
    runs = groups.withColumn("__from", F.explode(F.expr(f"sequence(0L, __n - 1, {_RUN}L)")))
    # runs of one record go to different tasks before they become rows
    runs = runs.repartition(F.xxhash64("__from", *[F.col(f"`{c}`") for c in records.columns]))
    copies = runs.withColumn(name, F.explode(F.expr(f"sequence(__from, least(__from + {_RUN}, __n) - 1)"))).drop("__n", "__from")
    return records.where(~is_hot).withColumn(name, F.lit(0).cast("long")).unionByName(copies)


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes docs, in shuffled order, below path/shard=K. Columns shard and slot are added; clashing ones are replaced.

    Slots are gapless from 0 in each shard, and each file is in their order. The order depends on the seed and the rows,
    not on partitions. Rows alike in all columns each get a place; nulls count as values; an empty table gives no files
    with rows.
    """
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    records = docs.select(*[F.col(f"`{c}`") for c in own])
    drawn = lambda s, *more: F.xxhash64(F.lit(s), *[F.col(f"`{c}`") for c in own], *more)
    rows, total = records.agg(F.count("*"), F.coalesce(F.sum(_bytes(records)), F.lit(0).cast('long'))).first()
    each = _copies_numbered(records, drawn(seed + 2), rows, "__copy")
    bucketed = each.withColumn("__bucket", F.pmod(drawn(seed, "__copy"), F.lit(max(1, -(-total // bucket_bytes)))).cast("long"))
    sizes = bucketed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = keep(offsets_of(sizes, "__bucket", "__n", "__before"), "buckets")
    mixed = bucketed.withColumn("__pos", F.row_number().over(Window.partitionBy("__bucket").orderBy(drawn(seed + 1, "__copy"))) - 1)
    place = F.col("__before") + F.col("__pos")
    dealt = mixed.join(before, "__bucket").select(*[F.col(f"`{c}`") for c in own], (place % n_shards).cast("int").alias("shard"), F.floor(place / n_shards).cast("long").alias("slot"))
    dealt.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    forget(before)


def read_shards(spark: SparkSession, path: str, schema) -> DataFrame:
    """The records of write_shards() with shard and slot; schema: of the records that were written."""
    full = StructType([f for f in schema if f.name not in ("shard", "slot")]).add("slot", LongType()).add("shard", IntegerType())
    return spark.read.schema(full).parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, read back from the written shards; law `rows`. A null text has no bytes."""
    docs, path = table(spark, sf_dir, "documents"), new_path(spark, "shards")
    write_shards(docs, path)
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    return read_shards(spark, path, docs.schema).select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
