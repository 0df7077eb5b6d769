"""SentencePiece encoding by sampled segmentations, and decoding.

A text's segmentations are the paths of a lattice over its pieces. Gumbel top-k without replacement is an A* search from
the top: the root holds all segmentations and a Gumbel value; taking the best open set yields its most perturbed
segmentation, and the rest of the set is split by the step at which other segmentations leave it. A set's mass is exact
(prefix weight times the lattice's backward sums), so its Gumbel value, truncated by its parent's, is an exact bound.
The k results are distinct; kappa, the best value left, gives each one's inclusion score 1 - exp(-exp(logp - kappa)).

The vocabulary is a merge list, whose scores are ranks: a piece's weight is Zipf's, 1 / (rank + 10), to the power alpha.
Spaces start pieces and never stand inside one, so lattices are built for each word of a batch once and kept in flat
arrays. All texts of a batch walk together; a text's random numbers are a counter's, hashed with its key, so they don't
depend on what else is in the batch.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, table
from .tokens import in_small_batches, tokenizer_path

MODEL = "piece_bpe_32k.model"
_SPACE_MARK = ord("▁")


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points of the different words in a row, their sizes, words of all texts in a row by number, words of each text).

    A word is a run of space marks and what follows up to the next one. Words are told apart by 64-bit hashes, and each
    is compared with the first of its hash.
    """
    chars = np.array([len(t) for t in texts], np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return cp.astype(np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    mark = cp == _SPACE_MARK
    begin = mark.copy()
    begin[1:] &= ~mark[:-1]
    first = (np.cumsum(chars) - chars)[chars > 0]
    begin[first] = True
    start = np.flatnonzero(begin)
    size = np.diff(np.r_[start, len(cp)])
    per_text = np.zeros(len(texts), np.int64)
    per_text[chars > 0] = np.diff(np.r_[np.searchsorted(start, first), len(start)])
    place = np.arange(len(cp)) - np.repeat(start, size)
    for seed in range(8):
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(size.max()) + 1, _BASE, np.uint64))
            h = mix(np.add.reduceat(mix(cp + np.uint64(seed << 32)) * power[place], start) + size.astype(np.uint64))
        _, one, number = np.unique(h, return_index=True, return_inverse=True)
        if (size == size[one][number]).all() and (cp == cp[_ranges(start[one][number], size)]).all():
            return cp[_ranges(start[one], size[one])].astype(np.uint64), size[one], number, per_text
    raise ValueError("words with equal hashes")


class Table:
    """Look-up of 64-bit hashes: slots by their low bits, hashes that share a slot in further, smaller tables."""

    def __init__(self, hashes: np.ndarray, bits: int = 21):
        self.levels, left = [], np.arange(len(hashes))
        self.hashes = np.r_[hashes, np.uint64(0)]
        while len(left):
            slots = np.full(1 << bits, len(hashes), np.int32)
            slots[(hashes[left] >> np.uint64(64 - bits)).astype(np.int64)] = left
            self.levels.append((bits, slots))
            left = left[slots[(hashes[left] >> np.uint64(64 - bits)).astype(np.int64)] != left]
            bits = max(8, bits - 2)
            if len(self.levels) > 20:
                raise ValueError("equal hashes")

    def find(self, h: np.ndarray) -> np.ndarray:
        """The index of each hash, or -1."""
        bits, slots = self.levels[0]
        i = slots[(h >> np.uint64(64 - bits)).astype(np.int64)]
        out = np.where(self.hashes[i] == h, i, -1)
        miss = np.flatnonzero((out < 0) & (i < len(self.hashes) - 1))
        for bits, slots in self.levels[1:]:
            if not len(miss):
                break
            i = slots[(h[miss] >> np.uint64(64 - bits)).astype(np.int64)]
            hit = self.hashes[i] == h[miss]
            out[miss[hit]] = i[hit]
            miss = miss[~hit]
        return out


class Flat:
    """Lattices of words in arrays: nodes by their distance from the word's end, node 0 the end of every word.

    Edges of node n are first[n] to first[n + 1], the longest piece first: it is the likeliest as a rule, so a draw ends
    early. lp is an edge's log probability among all that leave its node; piece -1 - c is code point c as its bytes.
    """

    def __init__(self, first, source, dest, piece, lp):
        self.first, self.source, self.dest, self.piece, self.lp, self.p = first, source, dest, piece, lp, np.exp(lp)


class Lattices:
    """The vocabulary's weights, and lattices of words in flat arrays."""

    def __init__(self, model_path: str, alpha: float = 1.0):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = self.sp.get_piece_size()
        norm = math.log(sum(1 / (r + 10) for r in range(n)))
        weigh = lambda rank: alpha * (-math.log(rank + 10) - norm)
        self.byte_weight, self.byte, pieces = weigh(n), np.zeros(256, np.uint32), [self.sp.id_to_piece(i) for i in range(n)]
        self.raw = [p.encode() for p in pieces]
        prefixes: dict[str, tuple[int, float]] = {}
        for i, p in enumerate(pieces):
            if self.sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.raw[i] = bytes([int(p[3:5], 16)])
            elif not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i)):
                for k in range(1, len(p)):
                    prefixes.setdefault(p[:k], (-1, 0.0))
                prefixes[p] = (i, weigh(-self.sp.get_score(i)))
        hashes = np.zeros(len(prefixes), np.uint64)
        for r, p in enumerate(prefixes):
            h = 0
            for c in p:
                h = (h * _BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            hashes[r] = h
        self.table = Table(mix(hashes))
        values = list(prefixes.values())
        self.id = np.array([v[0] for v in values], np.int32)
        self.weight = np.array([v[1] for v in values])

    def normalize(self, text: str | None) -> str:
        return self.sp.normalize(text) if text else ""

    def build(self, texts: list[str]) -> tuple[Flat, list[np.ndarray]]:
        """(lattices of all words of the texts, each text's words as their first nodes)."""
        cp, size, number, per_text = _words(texts)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(cp))  # characters to the word's end
        order = np.argsort(left.astype(np.int16) if len(left) and left.max() < 1 << 15 else left, kind="stable")
        node = np.empty(len(cp), np.int32)
        node[order] = np.arange(1, len(cp) + 1, dtype=np.int32)
        root = node[np.cumsum(size) - size] if len(size) else np.zeros(0, np.int32)
        # edges of each length: characters whose text of that length is a piece, while it is a piece's beginning
        at, h, found = np.arange(len(cp)), np.zeros(len(cp), np.uint64), []
        single = np.zeros(len(cp), bool)
        length = 0
        while len(at):
            length += 1
            with np.errstate(over="ignore"):
                h = h * np.uint64(_BASE) + cp[at + (length - 1)] + np.uint64(1)
            i = self.table.find(mix(h))
            known = np.flatnonzero(i >= 0)
            at, h, i = at[known], h[known], i[known]
            ids = self.id[i]
            piece = np.flatnonzero(ids >= 0)
            own = at[piece]
            found.append((length, node[own], np.where(left[own] > length, node[np.minimum(own + length, len(cp) - 1)], 0), ids[piece], self.weight[i[piece]]))
            if length == 1:
                single[own] = True
            more = np.flatnonzero(left[at] > length)
            at, h = at[more], h[more]
        bare = np.flatnonzero(~single)  # code points as their bytes
        n_bytes = 1 + (cp[bare] > 0x7F) + (cp[bare] > 0x7FF) + (cp[bare] > 0xFFFF)
        found.append((1, node[bare], np.where(left[bare] > 1, node[np.minimum(bare + 1, len(cp) - 1)], 0), -1 - cp[bare].astype(np.int32), n_bytes * self.byte_weight))
        counts = np.zeros(len(cp) + 2, np.int64)
        for _, source, *_ in found:
            counts[source + 1] += 1  # a node has one edge of a length at most
        first = np.cumsum(counts)
        free, n = first.copy(), int(first[-1])
        source, dest, piece, weight = np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n)
        for _, s, d, i, w in sorted(found, key=lambda x: -x[0]):
            to = free[s]
            free[s] += 1
            source[to], dest[to], piece[to], weight[to] = s, d, i, w
        # sums of what leads to the end, by distance from it: nodes of a distance, and so their edges, are neighbours
        beta = np.zeros(len(cp) + 1)
        value = np.empty(n)
        ends = np.cumsum(np.bincount(left, minlength=1)) if len(left) else np.zeros(1, np.int64)
        for a, z in zip(ends[:-1] + 1, ends[1:] + 1):
            i, j = first[a], first[z]
            own = first[a:z] - i
            v = weight[i:j] + beta[dest[i:j]]
            top = np.maximum.reduceat(v, own)
            beta[a:z] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, np.diff(first[a : z + 1]))), own))
            value[i:j] = v
        return Flat(first, source, dest, piece, value - beta[source]), np.split(root[number], np.cumsum(per_text)[:-1])


_BASE = 0x9E3779B97F4A7C15 | 1
_STEP, _ROUND, _WORD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7))


def uniforms(keys: np.ndarray, n) -> np.ndarray:
    """Uniform numbers in (0, 1), the nth of each key: a counter through a finaliser, so no state and no order."""
    with np.errstate(over="ignore"):
        x = mix(mix(keys + np.asarray(n).astype(np.uint64) * _STEP) ^ _WORD)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _walk(flat: Flat, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sample from each node to its word's end: (edges of all, how many each has)."""
    at, alive, steps = nodes.astype(np.int64), np.flatnonzero(nodes), []
    size = np.zeros(len(nodes), np.int64)
    while len(alive):
        u = uniforms(keys[alive], len(steps))
        n = at[alive]
        e, last = flat.first[n], flat.first[n + 1] - 1
        open_ = np.flatnonzero((u >= flat.p[e]) & (e < last))
        while len(open_):
            i = e[open_]
            u[open_] -= flat.p[i]
            e[open_] = i = i + 1
            open_ = open_[(u[open_] >= flat.p[i]) & (i < last[open_])]
        steps.append((alive, e))
        size[alive] += 1
        at[alive] = n = flat.dest[e]
        alive = alive[n > 0]
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.int64)
    for k, (who, e) in enumerate(steps):
        out[start[who] + k] = e
    return out, size


class Paths:
    """One path of each of some texts: edges, the word each is in, weights of what precedes, and the open sets' values.

    The open set at a step holds the paths that are the same before it and leave by another edge there.
    """

    def __init__(self, flat: Flat, docs: np.ndarray, edges: np.ndarray, words: np.ndarray, size: np.ndarray, since: np.ndarray, value: np.ndarray, keys: np.ndarray):
        self.docs, self.edges, self.words, self.size, self.value = docs, edges, words, size, value
        self.start = np.cumsum(size) - size
        lp = flat.lp[edges]
        self.before, self.logp = np.empty(len(edges)), np.zeros(len(docs))
        for i, (a, n) in enumerate(zip(self.start.tolist(), size.tolist())):  # sums of one text alone: they are the same in any batch
            total = np.cumsum(lp[a : a + n])
            self.before[a], self.before[a + 1 : a + n], self.logp[i] = 0.0, total[:-1], total[-1]
        n = flat.source[edges]
        own = np.repeat(np.arange(len(docs)), size)
        step = np.arange(len(edges)) - self.start[own]
        self.open = np.full(len(edges), -np.inf)
        at = np.flatnonzero((step >= since[own]) & (flat.first[n + 1] - flat.first[n] > 1))
        mass = self.before[at] + np.log(np.maximum(-np.expm1(lp[at]), 1e-16))
        self.open[at] = perturbed(mass, value[own[at]], uniforms(keys[own[at]], step[at]))
        self.left = {}

    def best(self, n: int) -> np.ndarray:
        """The best open value of each of n texts."""
        out = np.full(n, -np.inf)
        if len(self.edges):
            out[self.docs] = np.maximum.reduceat(self.open, self.start)
        return out


def perturbed(mass: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values of sets with these log masses, at most `most`."""
    return mass - np.log(np.exp(np.minimum(mass - most, 700)) - np.log(u))


def sample_top_k(flat: Flat, roots: list[np.ndarray], k: int, keys: np.ndarray) -> tuple[list[Paths], np.ndarray]:
    """Up to k distinct paths of each text, best first (round by round), and kappa of each. Texts must have words.

    keys: a text's numbers depend on its key and on nothing else in the batch.
    """
    n_docs = len(roots)
    n_words = np.array([len(r) for r in roots], np.int64)
    begin = np.cumsum(n_words) - n_words
    all_roots = np.concatenate(roots) if roots else np.zeros(0, np.int64)
    word_of = np.arange(len(all_roots)) - np.repeat(begin, n_words)

    def draw(which: np.ndarray, nth: int, what: int) -> np.ndarray:
        """Keys of texts in a round: for walks, sets, choices."""
        with np.errstate(over="ignore"):
            return mix(keys[which] + np.uint64(4 * nth + what + 1) * _ROUND)

    def word_keys(text_keys: np.ndarray, word: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(text_keys + (word.astype(np.uint64) + np.uint64(1)) * _WORD)

    docs = np.arange(n_docs)
    edges, size = _walk(flat, all_roots, word_keys(np.repeat(draw(docs, 0, 0), n_words), word_of))
    per_doc = np.add.reduceat(size, begin) if n_docs else size
    value = -np.log(-np.log(uniforms(draw(docs, 0, 2), 0)))
    rounds = [Paths(flat, docs, edges, np.repeat(word_of, size), per_doc, np.zeros(n_docs, np.int64), value, draw(docs, 0, 1))]
    for nth in range(1, k):
        tops = np.stack([r.best(n_docs) for r in rounds])
        from_ = tops.argmax(0)
        value = tops[from_, docs]
        going = np.flatnonzero(value > -np.inf)
        if not len(going):
            break
        pick, u = {}, uniforms(draw(docs, nth, 2), 0)
        for r, path in enumerate(rounds):
            for i in np.flatnonzero(np.isin(path.docs, going) & (from_[path.docs] == r)).tolist():
                a, d = int(path.start[i]), int(path.docs[i])
                at = a + int(path.open[a : a + path.size[i]].argmax())
                node = int(flat.source[path.edges[at]])
                taken = path.left.setdefault(at, [int(path.edges[at])])
                choice = [e for e in range(int(flat.first[node]), int(flat.first[node + 1])) if e not in taken]
                w = flat.p[choice]
                e = choice[min(int(np.searchsorted(np.cumsum(w), u[d] * w.sum(), "right")), len(choice) - 1)]
                taken.append(e)
                # what is left of the set keeps an open place
                rest = float(sum(flat.p[x] for x in choice if x != e))
                again = uniforms(draw(np.array([d]), nth, 3), 0)
                path.open[at] = perturbed(path.before[at] + math.log(max(rest, 1e-300)), value[d], again)[0] if len(choice) > 1 else -math.inf
                pick[d] = (r, i, at - a, e)
        head = [pick[d] for d in going.tolist()]
        kept, edge = np.array([x[2] for x in head]), np.array([x[3] for x in head])
        word = np.array([rounds[r].words[rounds[r].start[i] + s] for r, i, s, _ in head])
        # the rest of the word that is left, then the words after it
        n_tail = n_words[going] - word
        where = _ranges(begin[going] + word, n_tail)
        nodes, lead = all_roots[where].astype(np.int64), np.cumsum(n_tail) - n_tail
        nodes[lead] = flat.dest[edge]
        tail, size = _walk(flat, nodes, word_keys(np.repeat(draw(going, nth, 0), n_tail), word_of[where]))
        n_edges = np.add.reduceat(size, lead)
        total = kept + 1 + n_edges
        edges, words = np.empty(int(total.sum()), np.int64), np.empty(int(total.sum()), np.int64)
        start = np.cumsum(total) - total
        for (r, i, s, _), a in zip(head, start.tolist()):
            old = int(rounds[r].start[i])
            edges[a : a + s], words[a : a + s] = rounds[r].edges[old : old + s], rounds[r].words[old : old + s]
        edges[start + kept], words[start + kept] = edge, word
        to = _ranges(start + kept + 1, n_edges)
        edges[to], words[to] = tail, np.repeat(word_of[where], size)
        rounds.append(Paths(flat, going, edges, words, total, kept + 1, value[going], draw(going, nth, 1)))
    return rounds, np.stack([r.best(n_docs) for r in rounds]).max(0)


def _ids(lat: Lattices, flat: Flat, edges: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all paths in a row, how many each has): pieces, and code points that are none as their bytes."""
    p = flat.piece[edges]
    odd = np.flatnonzero(p < 0)
    if not len(odd):
        return p.astype(np.uint32), size
    cp = (-1 - p[odd]).astype(np.int64)
    n = np.ones(len(p), np.int64)
    n[odd] += (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    at = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.uint32)
    out[at[p >= 0]] = p[p >= 0]
    codes, inverse = np.unique(cp, return_inverse=True)
    raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes.tolist()]
    many = np.array([len(x) for x in raw])[inverse]
    flat_bytes = np.frombuffer(b"".join(raw), np.uint8)
    first = np.cumsum([0, *map(len, raw)])[:-1][inverse]
    out[_ranges(at[odd], many)] = lat.byte[flat_bytes[_ranges(first, many)]]
    ends = np.cumsum(n)[np.cumsum(size) - 1] if len(size) else np.zeros(0, np.int64)
    return out, np.diff(np.r_[0, ends])


def decode_ids(lat: Lattices, ids: np.ndarray) -> str:
    """The text of ids: their pieces and bytes in a row, spaces put back; bytes that are no text go through the library."""
    try:
        return b"".join(map(lat.raw.__getitem__, ids.tolist())).decode().replace("▁", " ").removeprefix(" ")
    except UnicodeDecodeError:
        return lat.sp.decode(ids.tolist())


@lru_cache(maxsize=1)
def lattices(model_path: str, alpha: float) -> Lattices:
    """Kept for all tasks of a worker."""
    return Lattices(model_path, alpha)


def _samples(model_path: str, k: int, seed: int, alpha: float, digest: bool):
    def run(batches):
        lat = lattices(model_path, alpha)
        for b in in_small_batches(batches, 1):
            docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            flat, roots = lat.build([lat.normalize(t) for t in texts])
            own = [i for i, r in enumerate(roots) if len(r)]
            keys = np.array([xxhash.xxh3_64_intdigest(str(docs[i]), seed=seed) for i in own], np.uint64)
            rounds, kappa = sample_top_k(flat, [roots[i] for i in own], k, keys) if own else ([], np.zeros(0))
            none = np.zeros(0, np.uint32)
            rows = [(docs[i], 0, none, 0.0, 0.0, 1.0, not texts[i]) for i, r in enumerate(roots) if not len(r)]
            for nth, paths in enumerate(rounds):
                ids, size = _ids(lat, flat, paths.edges, paths.size)
                ends = np.cumsum(size)
                with np.errstate(over="ignore"):
                    score = np.where(np.isneginf(kappa[paths.docs]), 1.0, -np.expm1(-np.exp(np.minimum(paths.logp - kappa[paths.docs], 50))))
                for d, a, z, logp, value, s in zip(paths.docs.tolist(), (ends - size).tolist(), ends.tolist(), paths.logp.tolist(), paths.value.tolist(), score.tolist()):
                    x = ids[a:z]
                    rows.append((docs[own[d]], nth, x, logp, value, s, decode_ids(lat, x) == texts[own[d]] if digest else None))
            cols = list(zip(*rows)) or [()] * 7
            head = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32())]
            tail = [pa.array(c, pa.float64()) for c in cols[3:6]]
            if digest:
                mid = [pa.array([len(x) for x in cols[2]], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cols[2]], pa.int64())]
                yield pa.RecordBatch.from_arrays([*head, *mid, *tail, pa.array(cols[6], pa.bool_())], names=["doc_id", "nth", "n_tokens", "ids_crc32", "log_probability", "perturbed", "inclusion", "round_trip"])
            else:
                yield pa.RecordBatch.from_arrays([*head, pa.array([x.astype(np.int32) for x in cols[2]], pa.list_(pa.int32())), *tail], names=["doc_id", "nth", "ids", "log_probability", "perturbed", "inclusion"])

    return run


def sample_segmentations(docs: DataFrame, k: int = 2, seed: int = 1, alpha: float = 1.0, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, nth, ids, log_probability, perturbed, inclusion: up to k distinct segmentations of each whole text.

    Seeded by the row's id: any order or partitioning gives the same result, and rows repeated with one id and text
    the same samples. Null and empty texts have the one empty segmentation; null ids are kept; an empty table gives
    no rows; texts with fewer than k segmentations give all of them, each with inclusion 1.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_samples(model or tokenizer_path(MODEL), k, seed, alpha, False), "doc_id long, nth int, ids array<int>, log_probability double, perturbed double, inclusion double")


def decode(ids_col, model: str | None = None):
    """Column of the texts of lists of ids; null for null."""
    path = model or tokenizer_path(MODEL)

    def run(ids: pd.Series) -> pd.Series:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return pd.Series([None if x is None else sp.decode([int(i) for i in x]) for x in ids], dtype=object)

    return F.pandas_udf(run, "string")(ids_col)


def op8_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document: counts, checksum, scores, and whether decoding gives the text back."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    schema = "doc_id long, nth int, n_tokens long, ids_crc32 long, log_probability double, perturbed double, inclusion double, round_trip boolean"
    return rows.mapInArrow(_samples(tokenizer_path(MODEL), 2, 1, 1.0, True), schema)
