"""Quality rules: base counts, and n-gram perplexity inside bands of the language.

The model is modified Kneser-Ney over 4 characters, of all scripts: lower-cased code points, digits alike, white space
alike. Spark counts it over all texts, works out the probabilities of all orders by joins, and keeps them as a table of
(hash, log probability) in sorted ranges on the shared storage. It grows with the corpus, so no task, and not the driver,
ever holds it whole: the different 4-grams of each stretch of texts ask it for their values by one join, and each
stretch's texts are scored against the sorted arrays that come back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, forget, keep, table
from .tokens import in_small_batches

ORDER = 4
#: A band reaches from the language's median this many quartile distances down and up.
BELOW, ABOVE = 7.0, 7.0
#: Least quartile distance, in nats, so that a corpus of copies doesn't reject all that differs.
LEAST_SPREAD = 0.01


def _symbols() -> np.ndarray:
    """A 16-bit symbol for each code point below 2^16: itself, but white space and digits are alike."""
    out = np.arange(1 << 16, dtype=np.uint64)
    out[[ord(c) for c in BLANKS]] = ord(" ")
    out[ord("0") : ord("9") + 1] = ord("0")
    out[0] = 1  # 0 stands before a text
    return out


_TABLE = _symbols()


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each character with the three before it, of all texts in a row, and each text's number of characters.

    A hash is the four symbols in a row; code points beyond 16 bits share the 6400 private ones, which texts don't use.
    """
    lower = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in lower], np.int64)
    cps = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _TABLE[np.where(cps < 1 << 16, cps, 0xE000 + cps % 0x1900)]
    key = s.copy()
    starts = np.cumsum(sizes) - sizes
    at = np.arange(len(s)) - np.repeat(starts, sizes) if len(s) else np.zeros(0, np.int64)
    for d in range(1, ORDER):
        before = np.zeros_like(s)
        before[d:] = s[:-d] if d < len(s) else s[:0]
        before[at < d] = 0
        key |= before << np.uint64(16 * d)
    return key.view(np.int64), sizes


def _count(batches):
    """(block, key, n): the different 4-grams of a task's texts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    block = None

    def merged():
        k, n = (np.concatenate(x) for x in zip(*held))
        keys, inv = np.unique(k, return_inverse=True)
        return keys, np.bincount(inv, weights=n).astype(np.int64)

    for b in in_small_batches(batches, 3):
        if b.num_rows:
            block = b.column(0)[0].as_py()
        key, _ = grams([t for t in b.column(3).to_pylist() if t])
        if len(key):
            held.append(np.unique(key, return_counts=True))
        if len(held) > 16:
            held[:] = [merged()]
    if held:
        k, n = merged()
        for i in range(0, len(k), 100_000):
            part = k[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int32)), pa.array(part), pa.array(n[i : i + 100_000])], names=["block", "key", "n"])


def discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2, and 3 and more, from how many counts of 1 to 4 there are."""
    n = [max(1, x) for x in (ones, twos, threes, fours)]
    y = n[0] / (n[0] + 2 * n[1])
    d = 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))


def fit(counts: DataFrame) -> DataFrame:
    """(key, lp): natural log probability of each 4-gram's last symbol after the ones before it; counts: (key, n).

    Counts below the top order are of different symbols before. Each order interpolates with the one below it, the
    lowest with even chances of all symbols. Every step is an aggregate or an equi-join over different grams.
    """
    levels = {ORDER: counts.select("key", "n")}
    for n in range(ORDER - 1, 0, -1):
        mask = (1 << (16 * n)) - 1
        levels[n] = keep(levels[n + 1].groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.count("*").alias("n")), f"order{n}")
    symbols = levels[1].count() + 1
    lower = None
    for n in range(1, ORDER + 1):
        t = levels[n]
        ones = t.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first()
        d = discounts(*ones)
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        t = t.select("key", (F.col("n") - cut).alias("rest"), "n", cut.alias("cut"), F.shiftrightunsigned("key", 16).alias("ctx"))
        sums = t.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"))
        t = t.join(sums, "ctx")
        if lower is None:
            p = F.col("rest") / F.col("total") + F.col("freed") / F.col("total") / symbols
        else:
            t = t.withColumn("low", F.col("key").bitwiseAND(F.lit((1 << (16 * (n - 1))) - 1))).join(lower, "low")
            p = F.col("rest") / F.col("total") + F.col("freed") / F.col("total") * F.col("p")
        lower = t.select(F.col("key").alias("low"), p.alias("p"))
    model = lower.select(F.col("low").alias("key"), F.log("p").cast("float").alias("lp"))
    kept = keep(model.repartitionByRange("key").sortWithinPartitions("key"), "model")
    forget(*[levels[n] for n in range(1, ORDER)])
    return kept


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeated = 0
    n = len(words)
    if n > 3:
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
        m = len(seen)
        if m <= 2_000_000:
            code = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
        else:
            pair = np.unique(ids[:-2] * m + ids[1:-1], return_inverse=True)[1]
            code = pair * m + ids[2:]
        order = np.sort(code)
        often = np.unique(order[1:][order[1:] == order[:-1]])
        if len(often):
            i = np.minimum(np.searchsorted(often, code), len(often) - 1)
            hit = often[i] == code
            cover = np.zeros(n, bool)
            for d in range(3):
                cover[d : n - 2 + d] |= hit
            repeated = int(cover.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def _score_texts(b: pa.RecordBatch, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    texts = b.column("text").to_pylist()
    rows = [base_counts(t) for t in texts]
    key, sizes = grams([t or "" for t in texts])
    surprise = np.full(len(texts), np.nan)
    if len(key):
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        if not len(keys) or (keys[at] != key).any():
            raise RuntimeError("texts moved between two readings of the table")
        lp = np.r_[0.0, np.cumsum(values[at], dtype=np.float64)]
        ends = np.cumsum(sizes)
        with np.errstate(invalid="ignore", divide="ignore"):
            surprise = -(lp[ends] - lp[ends - sizes]) / sizes
    cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5
    names = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "surprise"]
    return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *cols, pa.array(surprise, from_pandas=True)], names=names)


def _facts(batches):
    """Rows come by block, its 4-grams' values first, then its texts."""
    block, held, sorted_ = None, [], None
    for b in in_small_batches(batches, 6):
        blocks, kinds = b.column("block").to_numpy(), b.column("kind").to_numpy()
        cuts = np.flatnonzero(np.r_[True, (np.diff(blocks) != 0) | (np.diff(kinds) != 0)]) if len(blocks) else []
        for i, j in zip(cuts, np.r_[cuts[1:], len(blocks)] if len(blocks) else []):
            if blocks[i] != block:
                block, held, sorted_ = blocks[i], [], None
            part = b.slice(i, j - i)
            if kinds[i] == 0:
                held.append((part.column("key").to_numpy(), part.column("lp").to_numpy()))
                continue
            if sorted_ is None:
                k, v = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0, np.float32))
                order = np.argsort(k)
                sorted_, held = (k[order], v[order]), []
            yield _score_texts(part, *sorted_)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, the base counts, perplexity, base_failed and kept of every row.

    Null and empty texts have zero counts, no perplexity, and fail. A null language is a language of its own. Rows
    repeated with one id come back each. An empty table gives no rows. docs is read twice and must be a table as read or
    written: its partitions are the blocks that ask the model.
    """
    rows = docs.select(F.spark_partition_id().alias("block"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    asked = keep(rows.mapInArrow(_count, "block int, key long, n long"), "grams")
    model = fit(asked.groupBy("key").agg(F.sum("n").alias("n")))
    null = lambda t: F.lit(None).cast(t)
    answers = asked.join(model, "key").select("block", F.lit(0).alias("kind"), "key", "lp", null("long").alias("doc_id"), null("string").alias("lang"), null("string").alias("text"))
    texts = rows.select("block", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("float").alias("lp"), "doc_id", "lang", "text")
    both = answers.unionByName(texts).repartition("block").sortWithinPartitions("block", "kind")
    facts = keep(both.mapInArrow(_facts, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, surprise double"), "facts")
    forget(asked, model)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    facts = facts.withColumn("base_failed", failed)
    # rounding bounds the distinct values that the exact percentile holds for a language
    quarts = facts.where("not base_failed").groupBy("lang").agg(F.percentile(F.round("surprise", 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    spread = lambda a, b: F.greatest(F.expr(f"q[{b}] - q[{a}]"), F.lit(LEAST_SPREAD))
    bands = quarts.select("lang", (F.expr("q[1]") - BELOW * spread(0, 1)).alias("low"), (F.expr("q[1]") + ABOVE * spread(1, 2)).alias("high"))
    inside = F.coalesce(F.col("surprise").between(F.col("low"), F.col("high")), F.lit(False))
    return facts.join(bands, "lang", "left").withColumn("kept", ~F.col("base_failed") & inside).withColumn("perplexity", F.exp("surprise"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and verdict of every document."""
    return assess(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")
