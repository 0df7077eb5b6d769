"""Token ids in Parquet: list columns, dictionary or delta encoding, small row groups and page indexes.

write_token_table() orders documents by id, encodes each whole text once and writes one list of ids a document, with the
document's token count and its offset in its file beside it, so offsets and counts are read without touching ids, and a
range of documents is read by the pages that hold it.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, new_path, table, task_id

END_ID = 1
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The settings that the encoder's short ways hold for.
_SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "ignore_merges": False}
#: Runs of at most so many bytes are merged together; longer ones go to the library's merge model one by one.
LONGEST_RUN = 32
#: Runs that are merged together at most, so that their matrix is small.
BLOCK = 1 << 13
_NONE = np.int32(1 << 30)


def _byte_letters() -> list[str]:
    """How byte-level tokenizers write each byte: printable ones as themselves, others above U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _plain_letters() -> np.ndarray:
    """Of each code point of two bytes, whether it is a Latin letter that stays or is one such letter in lower case."""
    ok = np.zeros(1 << 11, bool)
    for c in map(chr, range(0x80, 0x250)):
        ok[ord(c)] = c.isalpha() and len(c.lower()) == 1 and c.lower() < "\u0250" and all(unicodedata.normalize("NFC", x) == x for x in (c, c.lower()))
    return ok


_LETTERS = _byte_letters()
_LATIN = _plain_letters()
#: Bytes that a plain chunk never holds: ASCII without a print, and first bytes beyond two-byte characters.
_ODD = np.array([b < 32 or b == 127 or b >= 0xE0 for b in range(256)])
#: Kinds of bytes in lower case: blank, letter (all beyond ASCII), digit, sign.
_BLANK, _LETTER, _DIGIT, _SIGN = range(4)
_KIND = np.array([_BLANK if b == 32 else _LETTER if b >= 0x80 or 97 <= b <= 122 else _DIGIT if 48 <= b <= 57 else _SIGN for b in range(256)], np.uint8)


def _runs(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run that the tokenizer merges for itself, in plain chunks with blanks between them.

    Its pattern: 's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+
    """
    kind = _KIND[u]
    first = np.ones(len(u) + 3, bool)
    first[1 : len(u)] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    at = np.flatnonzero((u == ord("'")) & first[: len(u)])
    if len(at):
        after = np.append(u, np.zeros(2, np.uint8))
        x, y = after[at + 1], after[at + 2]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
        first[at[one | two] + 1] = False
        first[at[one] + 2] = first[at[two] + 3] = True
    start = np.flatnonzero(first[: len(u)])
    size = np.diff(np.append(start, len(u)))
    words = kind[start] != _BLANK
    return start[words], size[words]


class _Merges:
    """The merges of a byte-level BPE model, done for many runs at once: in each round every run does its first of least rank."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = {}
        for rank, m in enumerate(model["merges"]):
            x, y = m if isinstance(m, (list, tuple)) else m.split(" ")
            pairs[vocab[x] << 16 | vocab[y]] = rank, vocab[x + y]
        self.letter = np.array([vocab[c] for c in _LETTERS], np.int32)
        self.last = np.array([vocab[c + "</w>"] for c in _LETTERS], np.int32)
        self.pad = max(vocab.values()) + 1
        if self.pad >= 0xFFFF:
            raise KeyError("ids of more than two bytes")
        self.made = np.zeros(len(model["merges"]) + 1, np.int32)
        keys = np.fromiter(pairs, np.uint32, len(pairs))
        ranks, made = (np.array(x, np.int32) for x in zip(*pairs.values()))
        self.made[ranks] = made
        # open addressing; no pair is 0xFFFFFFFF
        self.bits = max(10, int(len(keys)).bit_length() + 2)
        self.keys, self.ranks = np.full(1 << self.bits, 0xFFFFFFFF, np.uint32), np.full(1 << self.bits, _NONE, np.int32)
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] == 0xFFFFFFFF
            self.keys[at[free]] = keys[free]
            put = self.keys[at] == keys
            self.ranks[at[put]] = ranks[put]
            keys, ranks, at = keys[~put], ranks[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of pairs of ids; _NONE where they don't merge. One dimension."""
        key = (x.astype(np.uint32) << np.uint32(16)) | y.astype(np.uint32)
        at = self._place(key)
        there = self.keys[at]
        out = self.ranks[at]
        open_ = np.flatnonzero(there != key)
        out[open_] = _NONE
        open_ = open_[there[open_] != 0xFFFFFFFF]
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.keys[at]
            hit = there == key[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            more = ~hit & (there != 0xFFFFFFFF)
            open_, at = open_[more], at[more]
        return out

    def merge(self, u: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all runs in a row, number of ids of each run) of runs of at most LONGEST_RUN bytes."""
        n_ids = np.zeros(len(start), np.int64)
        parts = []
        edges = [0, 1, 3, 5, 7, 9, 12, 16, 22, LONGEST_RUN]
        for low, width in zip(edges, edges[1:]):
            all_ = np.flatnonzero((size > low) & (size <= width))
            for own in (all_[i : i + BLOCK] for i in range(0, len(all_), BLOCK)):
                ids, n = self._matrix(u, start[own], size[own], width)
                n_ids[own] = n
                parts.append((own, ids, n))
        ends = np.cumsum(n_ids)
        flat = np.zeros(ends[-1] if len(ends) else 0, np.uint32)
        for own, ids, n in parts:
            flat[np.arange(len(ids)) + np.repeat(ends[own] - n - (np.cumsum(n) - n), n)] = ids
        return flat, n_ids

    def _matrix(self, u: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        cols = np.arange(width, dtype=np.int32)
        at = np.minimum(start[:, None] + cols, len(u) - 1)
        done = np.where(cols < size[:, None], self.letter[u[at]], np.int32(self.pad))
        done[np.arange(len(size)), size - 1] = self.last[u[start + size - 1]]
        if width > 1:
            ids, rows = done.copy(), np.arange(len(size))
            ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(size), width - 1)
            # every row left has merged in each round, so its last column is free
            while ranks.shape[1] and len(rows):
                j = ranks.argmin(1)
                least = ranks[np.arange(len(rows)), j]
                on = least < _NONE
                if not on.all():
                    off = ~on
                    done[rows[off], : ids.shape[1]], done[rows[off], ids.shape[1] :] = ids[off], self.pad
                    ids, ranks, rows, j, least = ids[on], ranks[on], rows[on], j[on], least[on]
                    if not len(rows):
                        break
                w, r = ids.shape[1], np.arange(len(rows))
                right = cols[: w - 1] > j[:, None]
                new = self.made[least]
                ids = np.where(right, ids[:, 1:], ids[:, :-1])
                ids[r, j] = new
                if w == 2:
                    ranks = np.zeros((len(rows), 0), np.int32)
                    break
                ranks = np.where(cols[: w - 2] >= j[:, None], ranks[:, 1:], ranks[:, :-1])
                l = np.flatnonzero(j > 0)
                ranks[l, j[l] - 1] = self.rank(ids[l, j[l] - 1], new[l])
                l = np.flatnonzero(j < w - 2)
                ranks[l, j[l]] = self.rank(new[l], ids[l, j[l] + 1])
            done[rows, : ids.shape[1]], done[rows, ids.shape[1] :] = ids, self.pad
        there = done != self.pad
        return done[there], there.sum(1)


class Encoder:
    """encode(texts) gives each text's ids (uint32), the same as the library's for the whole text.

    The tokenizer of TOKENIZER drops white space before it merges, so a text's ids are those of its blank-separated
    chunks in a row; chunks repeat, and each new one is encoded once. A chunk of printable ASCII and Latin letters of two
    bytes is only lowered by normalisation, so its runs are cut and merged here, those of all new chunks at once; all
    other chunks go to the library.
    Texts with "<|" (special tokens) and tokenizers of other settings go to the library whole. When the cache holds
    most_chunks, the chunks that came most often stay, half as many at most, so memory is bounded and common chunks
    aren't encoded anew.
    """

    def __init__(self, path: str, most_chunks: int = 600_000):
        from tokenizers import Tokenizer

        self.lib, self.most = Tokenizer.from_file(path), most_chunks
        self.lib.no_truncation()
        self.model, self.merges = self.lib.model, None
        state = json.loads(self.lib.to_str())
        special = all("<|" in t["content"] for t in state["added_tokens"])
        if special and all(state[k] == v for k, v in _SETTINGS.items()) and all(state["model"].get(k) == v for k, v in _MODEL.items()):
            try:
                self.merges = _Merges(state["model"])
            except KeyError:  # letters or merges that the vocabulary lacks
                pass
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.seen = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _age(self) -> None:
        """Forgets the rarer chunks."""
        n = len(self.numbers)
        seen = self.seen[:n]
        least = max(2, int(np.partition(seen, n - self.most // 2)[n - self.most // 2]) + 1)
        stay = np.flatnonzero(seen >= least)
        old, start, size, flat, seen = list(self.numbers), self.start[stay], self.size[stay], self.flat, seen[stay]
        self.clear()
        self.numbers = {old[i]: k for k, i in enumerate(stay.tolist())}
        ends = np.cumsum(size)
        self.used = int(ends[-1]) if len(ends) else 0
        self._room(len(stay), self.used)
        self.flat[: self.used] = flat[np.arange(self.used) + np.repeat(start - ends + size, size)]
        self.start[: len(stay)], self.size[: len(stay)], self.seen[: len(stay)] = ends - size, size, seen // 2

    def _room(self, chunks: int, ids: int) -> None:
        while ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while chunks > len(self.start):
            self.start, self.size, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.seen))

    def _plain(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all plain chunks in a row, number of ids of each)."""
        u = np.frombuffer(b" ".join(chunks).decode().lower().encode(), np.uint8)
        start, size = _runs(u)
        chunk = np.searchsorted(np.flatnonzero(u == 32), start)
        long = np.flatnonzero(size > LONGEST_RUN)
        size_here = size.copy()
        size_here[long] = 0
        flat, n = self.merges.merge(u, start, size_here)
        if len(long):
            ids = [[t.id for t in self.model.tokenize("".join(_LETTERS[b] for b in u[i : i + k].tolist()))] for i, k in zip(start[long].tolist(), size[long].tolist())]
            flat = np.insert(flat, np.repeat(np.cumsum(n)[long], list(map(len, ids))), list(chain.from_iterable(ids)))
            n[long] = list(map(len, ids))
        return flat, np.bincount(chunk, n, len(chunks)).astype(np.int64)

    def _learn(self, new: list[bytes]) -> None:
        """Gives new chunks the next numbers and their ids."""
        first, n = len(self.numbers), len(self.numbers) + len(new)
        self.numbers.update(zip(new, range(first, n)))
        u = np.frombuffer(b" ".join(new), np.uint8)
        odd = _ODD[u]
        two = np.flatnonzero((u >= 0xC0) & (u < 0xE0))
        odd[two] = ~_LATIN[(u[two].astype(np.int64) & 31) << 6 | u[np.minimum(two + 1, len(u) - 1)] & 63]
        plain = np.ones(len(new), bool)
        plain[np.searchsorted(np.flatnonzero(u == 32), np.flatnonzero(odd))] = False
        flat, size = self._plain([new[i] for i in np.flatnonzero(plain).tolist()])
        others = np.flatnonzero(~plain)
        words = [self.lib.encode(new[i].decode(), add_special_tokens=False).ids for i in others.tolist()]
        order = np.concatenate([np.flatnonzero(plain), others]) + first
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(words), np.uint32)])
        size = np.concatenate([size, np.fromiter(map(len, words), np.int64)])
        self._room(n, self.used + len(flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[order], self.size[order] = self.used + np.cumsum(size) - size, size
        self.used += len(flat)

    def encode(self, texts: pa.Array | list[str | bytes]) -> list[np.ndarray]:
        """Of strings, or an Arrow array of them, in which null is empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array([t.encode() if isinstance(t, str) else t for t in texts], pa.binary())
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return []
        if not self.merges:
            return [self._whole(t) for t in texts]
        if len(self.numbers) > self.most:
            self._age()
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        u = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]

        def holds(places: np.ndarray) -> np.ndarray:
            """Which texts a place of u lies in."""
            out = np.zeros(len(texts), bool)
            out[np.searchsorted(ends[1:] - ends[0], places, "right")] = True
            return out

        whole = holds(np.flatnonzero((u[:-1] == ord("<")) & (u[1:] == ord("|"))))
        # An upper-case letter that may compose with what follows it. The tokenizer composes before it lowers, and some
        # marks compose with one case only. Characters below U+0300 (first bytes under CC) are no marks and keep marks from it.
        marked = holds(np.flatnonzero((u[:-1] - np.uint8(65) < 26) & (u[1:] >= 0xCC)))
        lower = pc.ascii_lower(texts)
        if marked.any():
            lower = pc.if_else(pa.array(marked), texts, lower)
        if whole.any():
            lower = pc.if_else(pa.array(whole), "", lower)
        chunks = pc.ascii_split_whitespace(lower)
        coded = chunks.values.dictionary_encode()
        own = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.binary()))
        distinct = pc.binary_join(own, b" ")[0].as_py().split(b" ")
        number = np.fromiter(map(self.numbers.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(new := np.flatnonzero(number < 0)):
            number[new] = np.arange(len(new)) + len(self.numbers)
            self._learn([distinct[i] for i in new.tolist()])
        self.seen[number] += np.bincount(coded.indices.to_numpy(), minlength=len(distinct))
        size = self.size[number]
        to = np.append(0, np.cumsum(size))
        ids = self.flat[np.arange(to[-1]) + np.repeat(self.start[number] - to[:-1], size)]
        lists = pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(ids)).take(coded.indices)
        flat, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()[chunks.offsets.to_numpy()]
        return [self._whole(texts[i]) if w else flat[a:b] for i, (w, a, b) in enumerate(zip(whole.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()))]

    def _whole(self, text: pa.Scalar) -> np.ndarray:
        return np.array(self.lib.encode(text.as_py(), add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """Kept for all tasks of a worker."""
    return Encoder(path)


def in_small_batches(batches, column: int, most_bytes: int = 2 << 20):
    """Record batches cut so that the texts of each are about most_bytes; a single longer text stays whole."""
    for b in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0))
        at = np.cumsum(size) // most_bytes
        cuts = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(size)] if len(size) else [0]
        for i, j in zip(cuts[:-1], cuts[1:]):
            yield b.slice(i, j - i)


def _encode_rows(path: str, end_id: int):
    def run(batches):
        enc, part, start = encoder(path), task_id(), 0
        for b in in_small_batches(batches, 1):
            ids = [np.append(x, np.uint32(end_id)) for x in enc.encode(b.column(1))]
            n = np.array([len(x) for x in ids], np.int64)
            ends = np.cumsum(n)
            flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(start + ends - n), pa.array(n), lists], names=["doc_id", "part", "part_start", "n_tokens", "ids"])
            start += int(ends[-1]) if len(n) else 0

    return run


def write_token_table(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_rows: int = 1000) -> None:
    """Writes doc_id, part, part_start, n_tokens, ids in ascending doc_id order, null ids first.

    Null text is empty and gives the end id alone; rows that share an id follow each other; an empty table gives files
    without rows. encoding: "dictionary", or "delta" for delta-packed ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # by the text's hash too, so that rows of one id may fill several ranges
    ranged = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    encoded = ranged.mapInArrow(_encode_rows(tokenizer or tokenizer_path(), end_id), "doc_id long, part int, part_start long, n_tokens long, ids array<int>")
    writer = encoded.write.option("compression", "zstd").option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows)
    if encoding == "delta":
        writer = writer.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "PARQUET_2_0")
    writer.parquet(path)


_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def read_token_table(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of documents first..last; start counts the ids of all documents before each.

    Column pruning leaves ids unread where they aren't selected; the id bounds are pushed to row groups and pages.
    """
    rows = spark.read.schema(_SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    # one row a file
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _crc(batches):
    for b in batches:
        lists = b.column(3)
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
        crc = np.array([zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])], np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the written token table."""
    path = new_path(spark, "tokens")
    write_token_table(table(spark, sf_dir, "documents"), path)
    return read_token_table(spark, path).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
