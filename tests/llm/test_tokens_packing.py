import json
import string
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, normalizers

from eventlens.llm import packing, tokens
from eventlens.llm.queries import QUERIES


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAzÉé́ .,;:!?'#-_<|>endoftx\n\t \x1c1٣㊀ßİſK𝕏ﬁ的"), max_size=40))
def test_encoder_matches_library(text):
    from tokenizers import Tokenizer

    enc = test_encoder_matches_library.__dict__.setdefault("enc", None) or tokens.Encoder(tokens.tokenizer_path())
    test_encoder_matches_library.enc = enc
    assert enc.encode([text])[0].tolist() == enc.lib.encode(text, add_special_tokens=False).ids
    assert isinstance(enc.lib, Tokenizer)


def test_encoder_marks(lib):
    """Every combining mark after every ASCII letter: the library composes before it lowers."""
    enc = tokens.Encoder(tokens.tokenizer_path())
    marks = [chr(c) for c in range(0x300, 0x110000) if unicodedata.category(chr(c)).startswith("M")]
    texts = [f"{a}{m} x{a}{m}{a}" for a in string.ascii_letters for m in marks]
    want = lib.encode_batch(texts, add_special_tokens=False)
    bad = [t for t, w, got in zip(texts, want, enc.encode(texts)) if got.tolist() != w.ids]
    assert not bad, (len(bad), bad[:5])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_encoder_random_documents(parts):
    text = " Text\u030a Ŷ ".join(parts)
    enc = tokens.encoder(tokens.tokenizer_path())
    assert enc.encode([text])[0].tolist() == enc.lib.encode(text, add_special_tokens=False).ids


def test_encoder_merges_new_chunks_at_once(lib):
    """Plain chunks of a batch don't go to the library one by one, and their ids are the library's."""
    rng = np.random.default_rng(5)
    letters = np.array(list("eeetaoinshrdlucmfwypvbgkjqxzéñüßçÉÄØſªđ.,#%!0123456789" + "'" * 3))
    chunks = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 24, 20_000)]
    chunks += ["it's", "'tis", "x''s", "!'s'", "we'll've", "'r", "'", "a'lx", "9's9", "'dé", "Ée'RE", "ee" * 16, "th" * 15 + "e'm"]
    texts = [" ".join(chunks[i : i + 50]) for i in range(0, len(chunks), 50)]
    enc = tokens.Encoder(tokens.tokenizer_path())
    enc.lib = enc.model = None
    assert [x.tolist() for x in enc.encode(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_encoder_pair_ranks(lib):
    """Pairs asked alone and all at once, most of which don't merge."""
    model = json.loads(lib.to_str())["model"]
    merges, vocab = tokens._Merges(model), model["vocab"]
    pairs = [tuple(vocab[t] for t in (m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    want = {p: r for r, p in enumerate(pairs)}
    rng = np.random.default_rng(1)
    asked = pairs + [tuple(p) for p in rng.integers(0, len(vocab) + 1, (50_000, 2)).tolist()]
    x, y = (np.array(c, np.int32) for c in zip(*asked))
    expected = [want.get(p, int(tokens._NONE)) for p in asked]
    assert merges.rank(x, y).tolist() == expected
    for k in (1, 2, 3):
        assert all(merges.rank(x[i : i + k], y[i : i + k]).tolist() == expected[i : i + k] for i in range(0, len(asked) - k, 37))


def test_encoder_long_runs_slices_and_age(lib):
    texts = [None, "", " \t ", "a" * 33 + " b" * 3, "x" * 32, "é" * 17 + "'s", "zz <|endoftext|> qq", "Y̊ é", "\x1c1 的 tail", "new words ", None, "#" * 40 + "9" * 40]
    texts = texts * 3 + [f"w{i}q{i * 7} Text{i}" for i in range(300)]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    enc = tokens.Encoder(tokens.tokenizer_path(), most_chunks=40)
    column = pa.array(["before", *texts, "after"])
    for size in (1, 7, 100):
        assert [x.tolist() for i in range(0, len(texts), size) for x in enc.encode(column.slice(1 + i, min(size, len(texts) - i)))] == want
    assert len(enc.numbers) < 400


def test_encoder_of_another_tokenizer(tmp_path):
    """Texts go to the library whole where the settings are not those that the short ways hold for."""
    other = Tokenizer.from_file(tokens.tokenizer_path())
    other.normalizer = normalizers.NFC()
    other.save(str(tmp_path / "t.json"))
    texts = ["Some Words, it's É", "", "UPPER lower"]
    assert [x.tolist() for x in tokens.Encoder(str(tmp_path / "t.json")).encode(texts)] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_op6_brute(spark, sf_dir, lib):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want, at = [], 0
    for d, t in docs:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op6_token_binary"](spark, sf_dir).collect())) == want


def check_packing(rows, texts, lib, size):
    want = {}
    for d, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), size)):
            want.setdefault((d, k, s, len(ids[s : s + size]), crc(ids[s : s + size])), []).append(1)
    got, bins = {}, {}
    for r in rows:
        got.setdefault(tuple(r[:5]), []).append(1)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= size
    return len(bins)


def test_op2_brute(spark, sf_dir, lib):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op2_best_fit_packing"](spark, sf_dir).collect()
    n = check_packing(rows, texts, lib, 4096)
    assert n <= -(-sum(r.length for r in rows) // 4096) + 2


def test_edge_rows(spark, lib, tmp_path):
    texts = [(1, None), (1, None), (2, ""), (None, "abc def"), (3, "word " * 3000), (4, "x" * 50_000), (4, "x" * 50_000)]
    df = spark.createDataFrame([(d, t, "clash", 7) for d, t in texts], "doc_id long, text string, piece string, offset int")
    check_packing(packing.pack(df, size=512).collect(), texts, lib, 512)
    empty = df.limit(0)
    assert packing.pack(empty).count() == 0
    tokens.write_token_table(empty, str(tmp_path / "e"))
    assert tokens.read_token_table(spark, str(tmp_path / "e")).count() == 0
    for encoding in ("dictionary", "delta"):
        at = str(tmp_path / encoding)
        tokens.write_token_table(df, at, encoding=encoding)
        rows = tokens.read_token_table(spark, at).orderBy("start").collect()
        assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 4]
        assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
        assert all(len(r.ids) == r.n_tokens for r in rows)
        assert [r.doc_id for r in tokens.read_token_table(spark, at, 3, 3).collect()] == [3]


def test_sequences_are_written(spark, sf_dir, lib, tmp_path):
    """The written lists hold every document's ids, whole, where their pieces say."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packing.write_sequences(docs, str(tmp_path / "s"), size=512)
    got, ids = packing.read_sequences(spark, str(tmp_path / "s")).collect(), {}
    assert len({r.sequence_id for r in got}) == len(got)
    for r in got:
        assert len(r.ids) == sum(p.length for p in r.pieces) <= 512
        for p in r.pieces:
            ids.setdefault(p.doc_id, {})[p.start] = r.ids[p.offset : p.offset + p.length]
    for d, t in docs.collect():
        assert sum((x for _, x in sorted(ids[d].items())), []) == lib.encode(t or "", add_special_tokens=False).ids + [1]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_places_everything(h):
    got = {}
    for lengths, times in packing.plan(h, 64):
        assert sum(lengths) <= 64 and times > 0
        for n in lengths:
            got[n] = got.get(n, 0) + times
    assert got == h
