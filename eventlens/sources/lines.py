"""Lines before parsing: ordered reading, prefixes, sections, records of several lines.

Every line has an order column. A record number is a running count of header lines. Running counts over the whole stream
are made in two levels: counts within parts of the order, and the parts' totals (one row a part) carried over, so no task
sees more than one part.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strings import _c, java_regex, quote

#: Rows of a part, about, and parts at most: one row of a part's totals each.
PART, MOST_PARTS = 100_000, 20_000


def parts(df: DataFrame, order: str, rows: int = PART):
    """A function that adds __part, which grows with the column order and holds about rows rows each, whatever the order's values.

    One job reads the order column alone. Dense orders are cut by value; others at percentiles, by a binary search in
    the JVM. A part depends on the value only, so all uses of it agree, whenever a task runs.
    """
    from pyspark.ml.feature import Bucketizer

    n, low, high = df.agg(F.count(order), F.min(F.col(order).cast("double")), F.max(F.col(order).cast("double"))).first()
    if n <= rows:
        return lambda d: d.withColumn("__part", F.lit(0))
    rows = max(rows, -(-n // MOST_PARTS))
    if high - low < 4 * n:
        return lambda d: d.withColumn("__part", F.floor((F.col(order) - int(low)) / rows))
    k = -(-n // rows)
    probs = F.array(*[F.lit(i / k) for i in range(1, k)]) if k <= 1000 else F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: i / k)
    at = sorted(set(df.agg(F.percentile_approx(F.col(order).cast("double"), probs, 4 * k)).first()[0]))
    edges = [float("-inf"), *at, float("inf")]
    split = Bucketizer(splits=edges, inputCol="__order", outputCol="__part", handleInvalid="keep")
    return lambda d: split.transform(d.withColumn("__order", F.col(order).cast("double"))).drop("__order")


def running_sum(df: DataFrame, value: Column, order: str, name: str, cut=None) -> DataFrame:
    """df with the sum of value over all rows up to each, by the numeric column order; cut: what parts() gave for it."""
    cut = cut or parts(df, order)
    own = cut(df.withColumn("__v", value))
    totals = own.groupBy("__part").agg(F.sum("__v").alias("__t"))
    # MOST_PARTS rows at most
    before = totals.select("__part", (F.sum("__t").over(Window.orderBy("__part")) - F.col("__t")).alias("__before"))
    local = F.sum("__v").over(Window.partitionBy("__part").orderBy(order))
    return own.join(F.broadcast(before), "__part").withColumn(name, local + F.col("__before")).drop("__v", "__part", "__before", "__t")


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with row numbers from 1 in the order of several columns, the first of them a number or timestamp.

    Rows are counted in parts of the first column; ties go by the others.
    """
    first = df.withColumn("__first", F.unix_micros(F.col(by[0]).cast("timestamp")) if dict(df.dtypes)[by[0]].startswith("timestamp") else F.col(by[0]))
    own = parts(first, "__first")(first)
    totals = own.groupBy("__part").agg(F.count("*").alias("__t"))
    before = totals.select("__part", (F.sum("__t").over(Window.orderBy("__part")) - F.col("__t")).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*by))
    return own.join(F.broadcast(before), "__part").withColumn(name, (local + F.col("__before")).cast("long")).drop("__first", "__part", "__before")


def list_files(spark: SparkSession, paths: list[str], strict: bool = False) -> list[tuple[str, int]]:
    """(file, modification time) of files, folders (all below them) and globs, each in the order given, by name inside one."""
    found: list[tuple[str, int]] = []
    for p in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
        own = []
        for at in fs.globStatus(jpath) or []:
            if at.isFile():
                own.append((at.getPath().toString(), at.getModificationTime()))
                continue
            inside = fs.listFiles(at.getPath(), True)
            while inside.hasNext():
                f = inside.next()
                if not f.getPath().getName().startswith(("_", ".")):
                    own.append((f.getPath().toString(), f.getModificationTime()))
        if not own and strict:
            raise FileNotFoundError(p)
        found += sorted(own)
    return list(dict(reversed(found)).items())[::-1] if len({f for f, _ in found}) < len(found) else found


def read_lines(spark: SparkSession, paths: list[str], file_order: str = "cli", strict: bool = False) -> DataFrame:
    """value, _file, _line_num (from 1 in its file), _seq (order over all files: file rank, then line).

    Files are taken in the order given, by name, or by modification time; missing ones are skipped unless strict. Large
    files are read in splits: a line's number is its place in its split and the lines of the splits before it, so no task
    reads a whole file and no line moves. Compressed files are read by their extension; read_compressed() goes by content.
    """
    found = list_files(spark, paths, strict)
    if file_order == "name":
        found.sort(key=lambda x: x[0])
    elif file_order == "mtime":
        found.sort(key=lambda x: (x[1], x[0]))
    if not found:
        return spark.createDataFrame([], "value string, _file string, _line_num long, _seq long")
    rank = spark.createDataFrame([(f, i) for i, (f, _) in enumerate(found)], "_path string, _rank long")
    at = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = spark.read.text([f for f, _ in found]).select("value", at[0].alias("_file"), at[1].alias("__block"), F.monotonically_increasing_id().alias("__id"))
    # one row a split; ids are consecutive inside one
    splits = lines.groupBy("_file", "__block").agg(F.min("__id").alias("__from"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("_file").orderBy("__block")) - F.col("__n")
    # text paths come back encoded as URIs; compare them without their scheme's slashes
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^([a-z0-9]+):/+", "$1:/")
    splits = splits.withColumn("__before", before).withColumn("__key", plain(F.col("_file")))
    splits = splits.join(rank.withColumn("__key", F.regexp_replace("_path", "^([a-z0-9]+):/+", "$1:/")), "__key").select(F.col("_file").alias("__f"), F.col("__block").alias("__b"), "__from", "__before", "_rank", "_path")
    joined = lines.join(splits, (F.col("_file") == F.col("__f")) & (F.col("__block") == F.col("__b")))
    number = F.col("__before") + F.col("__id") - F.col("__from") + 1
    return joined.select("value", F.col("_path").alias("_file"), number.alias("_line_num"), (F.col("_rank") * (1 << 40) + number).alias("_seq"))


def read_compressed(spark: SparkSession, path: str, batch: int = 10_000) -> DataFrame:
    """Lines of gzip or zstd files told by their first bytes; zip is an error. One file is one task, read as a stream of batches."""

    def expand(batches):
        import gzip
        import io

        import zstandard

        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                data = bytes(data)
                if data[:4] == b"PK\x03\x04":
                    raise ValueError(f"zip is not supported: {p}")
                raw = io.BytesIO(data)
                opened = gzip.open(raw) if data[:3] == b"\x1f\x8b\x08" else zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) if data[:4] == b"\x28\xb5\x2f\xfd" else raw
                rows = []
                for i, line in enumerate(io.TextIOWrapper(opened, "utf-8", "replace", newline="\n"), 1):
                    rows.append((p, i, line.removesuffix("\n").removesuffix("\r")))
                    if len(rows) == batch:
                        yield pd.DataFrame(rows, columns=["_file", "_line_num", "value"])
                        rows = []
                yield pd.DataFrame(rows, columns=["_file", "_line_num", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(expand, "_file string, _line_num long, value string")


def check_utf8(binary, strict: bool = False) -> Column:
    """Text of bytes; bad ones become U+FFFD, or an error when strict."""
    return F.validate_utf8(_c(binary).cast("string")) if strict else F.make_valid_utf8(_c(binary).cast("string"))


def limit_bytes(v, most: int = 64 << 20, strict: bool = False) -> Column:
    """Longer lines are cut to most bytes, or an error when strict."""
    col = _c(v)
    long = F.octet_length(col) > most
    cut = F.make_valid_utf8(F.substring(F.encode(col, "UTF-8"), F.lit(1), F.lit(most)).cast("string"))
    return F.when(long, F.raise_error(F.lit("line too long")).cast("string") if strict else cut).otherwise(col)


def skip_lines(df: DataFrame, order: str, n: int) -> DataFrame:
    """Without the first n lines of the stream."""
    gone = df.select(order).orderBy(order).limit(n).agg(F.max(order).alias("__top"))
    return df.crossJoin(F.broadcast(gone)).where(F.col("__top").isNull() | (F.col(order) > F.col("__top"))).drop("__top")


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def keep_ignore(df: DataFrame, value: str, keep: str | None = None, ignore: str | None = None, blank: bool = False) -> DataFrame:
    """Lines that match keep and not ignore; blank ones go, unless the format is line."""
    if keep:
        df = df.where(F.col(value).rlike(java_regex(keep)[0]))
    if ignore:
        df = df.where(~F.col(value).rlike(java_regex(ignore)[0]))
    return df if blank else df.where(F.col(value).rlike(r"\S"))


def extract_prefix(df: DataFrame, value: str, field: str, sep: str = "|") -> DataFrame:
    """The trimmed text before the first separator goes to field; without a separator nothing changes."""
    v = F.col(value)
    has = F.contains(v, F.lit(sep))
    prefix = F.nullif(F.trim(F.substring_index(v, sep, 1)), F.lit(""))
    rest = F.substring(v, F.locate(sep, v) + len(sep), F.length(v))
    return df.withColumns({field: F.when(has, prefix), value: F.when(has, F.ltrim(rest)).otherwise(v)})


def sections(df: DataFrame, value: str, order: str, start: str | None = None, after: bool = False, end: str | None = None, through: bool = False, most: int | None = None) -> DataFrame:
    """Lines inside sections, with their number _section.

    A section begins at (or after) a line that matches start; without start the stream begins inside one. It ends before
    (or through) a line that matches end; a start inside an open section begins the next. Which of a line's marks count
    is settled by the mark before it, so this is two running values and no state machine over the stream.
    """
    from ..operators.spans import before_last

    v, cut = F.col(value), parts(df, order)
    is_start = v.rlike(java_regex(start)[0]) if start else F.lit(False)
    is_end = v.rlike(java_regex(end)[0]) & ~is_start if end else F.lit(False)
    marked = df.withColumns({"__s": is_start, "__e": is_end})
    marked = running_sum(marked, F.col("__s").cast("long"), order, "__n", cut) if start else marked.withColumn("__n", F.lit(0).cast("long"))
    # the first end after a start closes it: ends so far, less those before the section
    marked = running_sum(marked, F.col("__e").cast("long"), order, "__ends", cut) if end else marked.withColumn("__ends", F.lit(0).cast("long"))
    if start and end:
        own = F.when(F.col("__s"), F.col("__ends"))
        marked = before_last(marked, order, "__base", own, cut=cut)
        marked = marked.withColumn("__ends", F.col("__ends") - F.coalesce(own, "__base", F.lit(0))).drop("__base")
    inside = (F.col("__n") > 0) | F.lit(start is None)
    last = F.col("__e") & (F.col("__ends") == 1) & F.lit(through)
    keep = inside & ((F.col("__ends") == 0) | last) & ~(F.col("__s") & F.lit(after))
    out = marked.where(keep).withColumn("_section", F.col("__n") + (1 if start is None else 0))
    if most is not None:
        out = out.where(F.col("_section") <= most)
    return out.drop("__s", "__e", "__n", "__ends")


_TS_HEAD = (
    r"^(?:\[?\d{4}[-/]\d{2}[-/]\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?|\[?\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}|[A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}"
    r"|(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? \d{1,2} [A-Z][a-z]{2} \d{4}|\d{10}(?:\d{3})?(?:\.\d+)?\b|\d{2}\.\d{2}\.\d{4} \d{2}:\d{2})"
)


def multiline(df: DataFrame, value: str, order: str, mode: str, match: str | None = None, end: str | None = None, joiner: str = " ", fmt: str | None = None) -> DataFrame:
    """Records of several lines: (_seq of the first, value, _lines).

    mode: timestamp (a line that begins with one, of the form fmt where it is named), indent (an unindented or empty line), regex (match begins a record, end
    ends it), all (the whole input, joined by newlines).
    """
    from ..functions.datetime import java_format, shape

    v = F.col(value)
    if mode == "all":
        return multiline_all(df, value, order)
    if mode == "timestamp":
        begins = v.rlike(_TS_HEAD if fmt is None else shape(java_format(fmt)).removesuffix(r"\z"))
    elif mode == "indent":
        begins = ~v.rlike(r"^\s")
    elif mode == "regex":
        begins = v.rlike(java_regex(match)[0])
    else:
        raise ValueError(f"unknown mode: {mode}")
    flags, cut = df.withColumn("__b", begins.cast("long")), parts(df, order)
    if end:
        # a line after an ending one begins a record: the ends before it are counted in, once each
        flags = running_sum(flags, v.rlike(java_regex(end)[0]).cast("long"), order, "__ended", cut).withColumn("__ended", F.col("__ended") - v.rlike(java_regex(end)[0]).cast("long"))
    flags = running_sum(flags, F.col("__b"), order, "__r", cut)
    keys = ["__r", "__ended"] if end else ["__r"]
    lines = F.array_sort(F.collect_list(F.struct(F.col(order), v.alias("v"))))
    return flags.groupBy(*keys).agg(F.min(order).alias(order), lines.alias("__l")).select(order, F.array_join(F.transform("__l", lambda x: x["v"]), joiner).alias(value), F.size("__l").alias("_lines"))


def multiline_all(df: DataFrame, value: str, order: str, by: list[str] | None = None) -> DataFrame:
    """All lines as one record, joined by newlines; one for each value of by. A record is one value, so it must fit in one row."""
    lines = F.array_sort(F.collect_list(F.struct(order, value)))
    one = df.groupBy(*(by or [])).agg(F.min(order).alias(order), lines.alias("__l")).where(F.size("__l") > 0)
    return one.select(*(by or []), order, F.array_join(F.transform("__l", lambda x: x[value]), "\n").alias(value), F.size("__l").alias("_lines"))


def csv_records(df: DataFrame, value: str, order: str) -> DataFrame:
    """Lines joined while a quoted field is open: a line goes on where the quotes before it are odd in number."""
    quotes = F.length(value) - F.length(F.replace(F.col(value), F.lit('"'), F.lit("")))
    cut = parts(df, order)
    odd = running_sum(df.withColumn("__q", F.pmod(quotes, F.lit(2)).cast("long")), F.col("__q"), order, "__sum", cut)
    begins = F.pmod(F.col("__sum") - F.col("__q"), F.lit(2)) == 0
    rec = running_sum(odd.withColumn("__b", begins.cast("long")), F.col("__b"), order, "__r", cut)
    lines = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).alias("v"))))
    return rec.groupBy("__r").agg(F.min(order).alias(order), lines.alias("__l")).select(order, F.array_join(F.transform("__l", lambda x: x["v"]), "\n").alias(value))


def sorted_stream(df: DataFrame, ts: str, line: str) -> DataFrame:
    """df with its line order as _line: an input of merge_sorted()."""
    return df.withColumn("_line", F.col(line))


def merge_sorted(frames: list[DataFrame], ts: str, line: str) -> DataFrame:
    """One stream of files that are each sorted by ts; an error where one isn't, where a row has no ts, or a file is empty.

    Whether a file is sorted is seen from each row's last timestamp before it, carried over parts of the line order; the
    merged order is a range sort by (ts, file, line).
    """
    from ..operators.spans import before_last

    out = None
    for i, f in enumerate(frames):
        if f.isEmpty():
            raise ValueError(f"input {i + 1} has no rows to merge")
        at = f.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
        at = before_last(at, line, "__last", F.col("__us"))
        bad = F.col(ts).isNull() | (F.col("__us") < F.col("__last"))
        kind = dict(f.dtypes)[ts]
        g = at.withColumn(ts, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("input is not sorted")).cast(kind)).otherwise(F.col(ts))).drop("__us", "__last")
        g = g.withColumn("_file_rank", F.lit(i))
        out = g if out is None else out.unionByName(g, allowMissingColumns=True)
    return out.orderBy(ts, "_file_rank", line)


def no_input(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "value string, _seq long")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "re", "pd", "quote")]
