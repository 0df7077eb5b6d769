"""The operators against brute force, and on edge rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import os
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from eventlens.llm import embeddup, linededup, neardup, quality, sampling, secrets, sharding, tokens, toxicity
from eventlens.llm.queries import ORACLE_SQL, QUERIES

from ..compare import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def edge(spark):
    """Rows with clashing names; ids 1 twice, a null id, null, empty, blank and long texts."""
    line = "this line is long enough to count as one"
    rows = [(1, None), (1, None), (2, ""), (3, " \n\t"), (4, "word " * 30_000), (5, line), (6, f"{line}\nx"), (7, f" {line.upper()} \ny"), (None, line), (8, "a b c"), (9, "a b c"), (10, None)]
    return spark.createDataFrame([(d, t, None, "s", 1, 2, "k") for d, t in rows], "doc_id long, text string, lang string, source string, shard int, slot int, component string")


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    same(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])


def test_neardup_edges(spark, edge):
    got = {(r.doc, r.n_shingles, r.component) for r in neardup.near_duplicates(edge, k=4).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (8, 1, 8), (9, 1, 8), (10, 0, 10)} <= got
    assert neardup.near_duplicates(edge.limit(0)).count() == 0
    kept = neardup.keep_one(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 3, 4, 5, 8, 10]  # 6 and 7 share 5 of 6 shingles with 5


def test_neardup_chain(spark):
    """Each text shares over 0.8 with the next; the ends share less: one class all the same."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 8 : 200 + i * 8])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component for r in neardup.near_duplicates(df).collect()} == {0}


@pytest.mark.parametrize("block,hot,bits", [(4, 6, 1 << 20), (3, 10_000, 0)])
def test_neardup_large_buckets(spark, monkeypatch, block, hot, bits):
    """Many members a block, large buckets told apart by a second band, sets without bits: the classes of brute force."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "MOST_BITS", bits)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    base = [list(rng.choice(words, 120)) for _ in range(4)]
    texts = []
    for i in range(120):
        w = base[i % 4][:]
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            w[at] = f"x{i}"
        texts.append(" ".join(w))
    sets = [{" ".join(t.split()[j : j + 4]) for j in range(117)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc: r.component for r in neardup.near_duplicates(df, k=4).collect()} == dict(enumerate(root))


@pytest.mark.parametrize("block,common", [(512, 20_000), (3, 20_000), (3, 0)])
def test_neardup_one_shared_band(spark, monkeypatch, block, common):
    """All texts share one band and no second one: the large bucket keeps every pair, however few meet elsewhere."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "HOT", 6)
    monkeypatch.setattr(neardup, "COMMON", common, raising=False)

    def keys(sig):
        out = [np.array([xxhash.xxh3_64_intdigest(s, seed=b) for b in range(neardup.BANDS)], np.uint64).view(np.int64) & ~31 | np.arange(32) for s in sig]
        for k in out:
            k[0] = 64
        return pd.Series(out)

    keys.__annotations__ = {"sig": pd.Series, "return": pd.Series}
    monkeypatch.setattr(neardup, "_band_keys", keys)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(3000)]
    passage = list(rng.choice(words, 40))
    texts = ["another text altogether, the smallest id"]
    for i in range(30):
        w = passage + list(rng.choice(words, 80))
        for at in ([], [117], [3, 60, 90, 100, 119])[: 1 + i % 3]:
            texts.append(" ".join("x" + str(i) if j in at else x for j, x in enumerate(w)))
    sets = [{" ".join(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(set(root)) < len(texts) - 15
    assert {r.doc: r.component for r in neardup.near_duplicates(df, k=4).collect()} == dict(enumerate(root))


def test_rarest_shingles_meet():
    """Of sets at the threshold, whatever is common, a rarest shingle is shared."""
    rng = np.random.default_rng(7)
    for size in (1, 2, 3, 5, 9, 10, 40, 333):
        for _ in range(20):
            pool = np.unique(rng.integers(-(1 << 62), 1 << 62, 2 * size))
            a = np.sort(rng.permutation(pool)[:size])
            gone = rng.integers(0, size // 5 + 1)  # the most that still leaves 0.8
            b = np.sort(rng.permutation(a)[: size - gone])
            assert 100 * len(b) >= 80 * len(a)
            common = np.sort(rng.permutation(pool)[: rng.integers(0, len(pool))])
            batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([0, 1]), pa.array([a, b], pa.list_(pa.int64()))], names=["rep", "comp", "s"])
            out = next(neardup._rarest(80, common, rng.integers(2, 9, len(common)))([batch]))
            key, rep = out.column(0).to_numpy(), out.column(1).to_numpy()
            assert set(key[rep == 0]) & set(key[rep == 1])


def test_long_sets_in_a_group():
    """Sets of a group are told apart in less memory than they take once more."""
    rng = np.random.default_rng(8)
    base = rng.integers(-(1 << 62), 1 << 62, 100_000)
    sets = [np.unique(np.r_[base, rng.integers(-(1 << 62), 1 << 62, n)]) for n in [15_000] * 23 + [100]]
    n, names = len(sets), ["key", "bi", "bj", "band", "block", "rep", "comp", "n", "sig", "s"]
    zero, ids = pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n))
    sig = pa.array([neardup.registers(s.view(np.uint64)).tobytes() for s in sets], pa.binary())
    batch = pa.RecordBatch.from_arrays([zero, zero, zero, pa.array(np.full(n, -1)), zero, ids, ids, pa.array([len(s) for s in sets]), sig, pa.array(sets, pa.list_(pa.int64()))], names=names)
    tracemalloc.start()
    found = [(r["u"], r["v"]) for b in neardup._block_links(0.62, 80)([batch]) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 23  # all are one component
    assert peak < 1.5 * sum(s.nbytes for s in sets)


def test_registers_merge():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64)) for _ in range(2))
    assert (neardup.registers(np.union1d(a, b)) == np.maximum(neardup.registers(a), neardup.registers(b))).all()


def test_joint_estimate():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    a, b = np.unique(pool[:1100]), np.unique(pool[100:])
    ra, rb = neardup.registers(a)[None], neardup.registers(b)[None]
    est = neardup.joint_estimate(ra, rb, np.array([float(len(a))]), np.array([float(len(b))]))[0]
    assert abs(est - 1000 / 1200) < 0.15


def test_line_dedup_edges(spark, edge):
    out = linededup.dedup_lines(edge)
    assert out.columns == edge.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    want = sorted([(r.doc_id, {5: "", 6: "x"}.get(r.doc_id, r.text)) for r in edge.collect()], key=repr)
    assert got == want
    assert linededup.dedup_lines(edge.limit(0)).count() == 0


def test_sharding(spark, sf_dir, edge, tmp_path):
    texts = texts_of(spark, sf_dir)
    rows = QUERIES["op7_sharding"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == sorted((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items())
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    assert sorted(shards) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.3
    sharding.write_shards(edge, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(((r.doc_id, r.text) for r in edge.collect()), key=repr)
    placed = sharding.assign_shards(edge.select("doc_id", "text"), ["doc_id"], 3).collect()
    assert len(placed) == 12 and len({(r.shard, r.slot) for r in placed}) == 12
    assert sharding.assign_shards(edge.limit(0), ["doc_id"]).count() == 0


def test_sharding_reads_back_what_was_written(spark, sf_dir, edge, tmp_path, monkeypatch):
    """op7's rows come from the shards: a text damaged while it is written shows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = texts_of(spark, sf_dir)
    write = sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda d, *a: write(d.withColumn("text", F.concat("text", F.lit("!"))), *a))
    rows = QUERIES["op7_sharding"](spark, sf_dir).collect()
    assert len(rows) == len(texts) and all(r.text_crc32 == zlib.crc32((texts[r.doc_id] + "!").encode()) for r in rows)
    # several buckets, all columns, gapless slots
    write(docs, str(tmp_path / "s"), 3, bucket_bytes=10_000)
    back = sharding.read_shards(spark, str(tmp_path / "s"), docs.schema)
    assert back.drop("shard", "slot").exceptAll(docs).count() == 0 and back.count() == docs.count()
    slots = defaultdict(list)
    for r in back.select("shard", "slot").collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    write(edge.limit(0), str(tmp_path / "e"))
    assert sharding.read_shards(spark, str(tmp_path / "e"), edge.schema).count() == 0


def test_sharding_is_a_function_of_the_seed(spark, sf_dir, tmp_path):
    """The same places under other partitionings; copies of one record, most of all rows, fall in many buckets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    places = []
    for n in (1, 5):
        at = str(tmp_path / f"p{n}")
        sharding.write_shards(docs.repartition(n), at, 3, bucket_bytes=20_000)
        places.append(sorted((r.doc_id, r.shard, r.slot) for r in sharding.read_shards(spark, at, docs.schema).collect()))
    assert places[0] == places[1]
    sharding.write_shards(docs, str(tmp_path / "other"), 3, seed=99, bucket_bytes=20_000)
    other = sorted((r.doc_id, r.shard, r.slot) for r in sharding.read_shards(spark, str(tmp_path / "other"), docs.schema).collect())
    assert sum(a == b for a, b in zip(places[0], other)) < len(other) / 10
    a, b = (sorted(map(tuple, sharding.assign_shards(docs.repartition(n).select("doc_id"), ["doc_id"], 3, bucket_rows=16).collect())) for n in (1, 5))
    assert a == b
    many = spark.range(6000).selectExpr("if(id < 4000, 1, id) as doc_id", "if(id < 4000, 'copy', 'own') as text")
    assert sharding._copies_numbered(many, F.xxhash64("doc_id"), 6000, "c").where("text = 'copy'").select("c").distinct().count() == 4000
    sharding.write_shards(many, str(tmp_path / "m"), 4, bucket_bytes=2000)
    back = sharding.read_shards(spark, str(tmp_path / "m"), many.schema)
    assert back.drop("shard", "slot").exceptAll(many).count() == 0 and back.count() == 6000
    by = Counter((r.shard, r.text) for r in back.collect())
    assert all(abs(by[k, "copy"] - 1000) < 150 for k in range(4))


def brute_base(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + d for i, w in enumerate(windows) if w in often for d in range(3)}
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality(spark, sf_dir, edge):
    rows = QUERIES["op4_quality_rules"](spark, sf_dir).collect()
    texts = texts_of(spark, sf_dir)
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r.base_failed and r.kept)
    passed = [r for r in rows if not r.base_failed]
    assert np.mean([r.kept for r in passed]) > 0.85
    out = quality.assess(edge).collect()
    assert len(out) == 12 and not any(r.kept for r in out)
    assert quality.assess(edge.limit(0)).count() == 0


def brute_surprise(texts):
    """Modified Kneser-Ney by dictionaries of strings: each text's mean surprise per character."""
    fold = lambda t: "".join(" " if c in " \t\n\x0b\x0c\r" else "0" if c in "0123456789" else c for c in t.lower())
    levels = {4: Counter()}
    all_grams = []
    for t in texts:
        x = "\0\0\0" + fold(t)
        all_grams.append([x[i : i + 4] for i in range(len(x) - 3)])
        levels[4].update(all_grams[-1])
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    p = {}
    for n in (1, 2, 3, 4):
        d = quality.discounts(*[sum(c == i for c in levels[n].values()) for i in (1, 2, 3, 4)])
        total, freed = Counter(), Counter()
        for g, c in levels[n].items():
            total[g[:-1]] += c
            freed[g[:-1]] += d[min(c, 3) - 1]
        for g, c in levels[n].items():
            low = p[g[1:]] if n > 1 else 1 / (len(levels[1]) + 1)
            p[g] = (c - d[min(c, 3) - 1]) / total[g[:-1]] + freed[g[:-1]] / total[g[:-1]] * low
    return [-np.mean([np.log(p[g]) for g in gs]) if gs else None for gs in all_grams], p


def test_perplexity_by_hand(spark):
    texts = ["the cat sat on the mat. the end", "another text,\twith 12 words", "", "слово за слово и ещё раз слово", "λόγος και πάλι λόγος", "短い文 です 短い文", "𝕏 marks the 𝕏", "the cat sat on the mat. the end"]
    want, p = brute_surprise(texts)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3, "doc_id")
    got = {r.doc_id: r.perplexity for r in quality.assess(df).collect()}
    assert set(got) == set(range(len(texts)))
    for i, w in enumerate(want):
        assert (got[i] is None) == (w is None) and (w is None or abs(np.log(got[i]) - w) < 1e-4), (i, got[i], w)
    # chances of all symbols after a context that was seen, and of one more, unseen, sum to 1 in each order below the top
    for n in (1, 2):
        for ctx in {g[:-1] for g in p if len(g) == n}:
            assert sum(v for g, v in p.items() if len(g) == n and g[:-1] == ctx) <= 1 + 1e-9


@pytest.mark.parametrize("letters", ["abcdefghiklmnoprstuv", "абвгдежзиклмнопрстуф", "αβγδεζηθικλμνοπρστυ"])
def test_salad_is_rejected(spark, letters):
    """In every script, texts of random letters stand out from texts of the language's words."""
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words, 160)), "xx") for i in range(160)]
    rows += [(1000 + i, "".join(rng.choice(list(letters + "  "), 900)), "xx") for i in range(4)]
    out = {r.doc_id: r for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(out[1000 + i].kept for i in range(4)) and sum(out[i].kept for i in range(160)) >= 158


def test_secrets(spark, sf_dir, edge):
    forest = secrets.train_forest(secrets.labelled_findings(spark))
    key = "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"
    rows = [(1, f'token = "{key}" end'), (2, "sha1 " + "0123456789abcdef" * 2 + "01234567 of the build"), (3, None), (4, ""), (5, f"{key} {key}")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, v string")
    got = {r.doc_id: r.text for r in secrets.redact(df, forest).collect()}
    assert got == {1: 'token = "[SECRET]" end', 2: rows[1][1], 3: None, 4: "", 5: "[SECRET] [SECRET]"}
    same_rows = secrets.redact(edge, forest)
    assert same_rows.columns == edge.columns and same_rows.count() == 12 and secrets.redact(edge.limit(0), forest).count() == 0
    texts = texts_of(spark, sf_dir)
    found = QUERIES["op5_secret_scan"](spark, sf_dir).collect()
    want = {(d, i, m.start(), len(m[0])) for d, t in texts.items() for i, m in enumerate(re.finditer(secrets.CANDIDATE, t))}
    assert {(r.doc_id, r.nth, r.start, r.length) for r in found} == want
    assert all(hashlib.sha256(texts[r.doc_id][r.start : r.start + r.length].encode()).hexdigest() == r.value_sha256 for r in found)
    held = secrets.labelled_findings(spark, 9000).where("1 = 1").tail(3000)  # made from ids the forest hasn't seen
    test = spark.createDataFrame(held).selectExpr("label", *[f"cast({sql} as double) as {n}" for n, sql in secrets.FEATURES.items()])
    right = test.withColumn("c", F.struct(*secrets.FEATURES)).select(((F.expr(forest) >= 0.5).cast("double") == F.col("label")).alias("ok")).agg(F.avg(F.col("ok").cast("double"))).first()[0]
    assert right > 0.95


def brute_features(v, before, after):
    """FEATURES of a finding by hand."""
    share = lambda p, x=v: len(re.findall(p, x)) / len(v)
    kind = lambda c: "d" if c in "0123456789" else "u" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else "s"
    changes = sum((a, b) in {("l", "d"), ("u", "d"), ("d", "l"), ("d", "u"), ("l", "u"), ("u", "l")} for a, b in zip(map(kind, v), map(kind, v[1:])))
    run = re.search("[A-Za-z]{7,}", v)
    left = re.sub(secrets._WORD_RE, "", v.lower())
    return {
        "f_len": len(v), "f_digit": share("[0-9]"), "f_upper": share("[A-Z]"), "f_sign": share("[^A-Za-z0-9]"), "f_hex": bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", v)), "f_change": changes / len(v),
        "f_distinct": len(set(v)) / min(len(v), 64), "f_words": 1 - len(left) / len(v), "f_vowels": share("[aeiouy]", v.lower()), "f_letters": len(run[0]) / len(v) if run else 0.0,
        "f_path": bool(re.search("[a-z]:/{0,2}[^ ]*$|[./~]$|/[^ ]*$", before) or re.search("^/|/[a-z]{3,}/|[a-z]+/[a-z]+/", v) or re.search(r"^[.][a-z]{2,4}\b", after)),
        "f_uuid": bool(re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", v)), "f_assign": bool(re.search("(?:[:=]|=>)[ \t]*[\"`']?$", before)), "f_quote": bool(re.search("[\"`']$", before) and re.search("^[\"`']", after)),
    }


def test_secret_features_by_hand(spark):
    rows = secrets.labelled_findings(spark, 1500).selectExpr("v", "before", "after", *[f"cast({sql} as double) as {n}" for n, sql in secrets.FEATURES.items()]).collect()
    for r in rows:
        for name, want in brute_features(r.v, r.before, r.after).items():
            assert abs(r[name] - float(want)) < 1e-9, (name, r)


def test_secret_edges(spark):
    """Clashing names, repeated and long texts, many candidates in one text, a late digit; places by hand."""
    forest = secrets.train_forest(secrets.labelled_findings(spark))
    late = "aBcDeFgHiJ" * 5 + "0123456789"
    many = " ".join(f"id {i:020d}" for i in range(300))
    texts = [late, many, "x " * 40_000 + f'token = "{late}"', late, None, "", "=" * 50, "a" * 100_000]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, __v int, __text int, __gaps int")
    out = secrets.redact(df, forest)
    assert out.columns == df.columns and {tuple(r)[2:] for r in out.collect()} == {(1, 2, 3)}
    found = secrets.scan(df.select("doc_id", "text"), forest)
    got = {r.doc_id: list(zip(r.s or [], [c.v for c in r["__found"]])) for r in found.select("doc_id", "__found", F.when(F.size("__found") > 0, secrets.starts_of()).alias("s")).collect()}
    assert got == {i: [(m.start(), m[0]) for m in re.finditer(secrets.CANDIDATE, t or "")] for i, t in enumerate(texts)}
    assert len(got[1]) == 300 and got[0] == [(0, late)] == got[3]
    assert secrets.scan(df.limit(0), forest).count() == 0


def test_secrets_after_names(spark):
    """Values after '=', short ones and ones without digits are candidates, and the forest calls them secrets."""
    values = {
        "token={} x": "ghp_abcdefghij0123456789abcdefghij012345",
        "GET /a?api_key={}&x": "0123456789abcdef0123456789abcdef",
        "AWS_SECRET_ACCESS_KEY={}\n": "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY".replace("EXAMPLE", "qZ7uTwp"),
        "export DB_PASSWORD={}": "Tr0ub4d&3"[:7],
        'password: "{}"': "kQzXvWbTrP",
        "secret_2_of_many_names=1&client_secret={}": "hT9kPq2x",
    }
    for form, v in values.items():
        assert v in [m[0] for m in re.finditer(secrets.CANDIDATE, form.format(v))], form
    findings = secrets.labelled_findings(spark, 2000)
    for r in findings.where("label = 1").collect():
        at = [(m.start(), m[0]) for m in re.finditer(secrets.CANDIDATE, r.before + r.v + r.after)]
        assert (len(r.before), r.v) in at, r
    df = spark.createDataFrame([(i, form.format(v)) for i, (form, v) in enumerate(values.items())], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(df, secrets.train_forest(secrets.labelled_findings(spark))).collect()}
    assert got == {i: form.format("[SECRET]") for i, form in enumerate(values)}


def test_toxicity_held_out(spark, edge):
    sf = os.environ.get("TEST_TOXICITY_DIR", "/root/testdata/sf0.1")
    if not os.path.exists(sf):
        pytest.skip("no larger tables")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").collect()}
    rows = QUERIES["op3_toxicity"](spark, sf).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    own = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    pos, neg = [s for y, s in own if y], [s for y, s in own if not y]
    assert np.mean([[p > n for n in neg] for p in pos]) > 0.93
    model = toxicity.train(edge, spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, toxic int"))
    scored = toxicity.score(edge, model)
    assert scored.count() == 12 and scored.where("__toxicity >= 0.5").count() == 0


def brute_kernel(a, b):
    """The subsequence kernel by enumeration of all letter triples."""
    from itertools import combinations

    def triples(w):
        out = defaultdict(float)
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < toxicity.SPAN:
                out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = triples(a), triples(b)
    return sum(v * y.get(t, 0.0) for t, v in x.items())


def test_kernel_by_enumeration():
    """Exact for every pair, equal letters, gaps, code points beyond 16 bits and all; nothing is cut off."""
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdé^𝕏"), rng.integers(0, 12))) for _ in range(120)] + ["^idiot", "ixdxixoxt", "ixxdxxixxoxxt", "a" * 24]
    got = toxicity.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            norm = brute_kernel(a, a) * brute_kernel(b, b)
            assert abs(got[i, j] - (brute_kernel(a, b) / np.sqrt(norm) if norm else 0)) < 1e-5
    assert toxicity.kernel(["ixxdxxixxoxxt"], ["idiot"])[0, 0] > 0.01


def test_word_map_is_a_nystroem_map():
    """Products of landmarks' maps are the squared kernel; of other words' they come near it; long words count whole."""
    marks = ["^idiot", "^moron", "^worthless", "^window", "^report", "^garden"]
    m = toxicity.WordMap(marks)
    z = m.maps([w[1:] for w in marks])
    assert np.abs(z @ z.T - toxicity.kernel(marks, marks) ** 2).max() < 1e-3
    near = m.maps(["idiots", "id1ot", "i.d.i.o.t", "x" * 90 + "idiot" + "y" * 90, "zebra"])
    s = near @ z[0]
    assert s[0] > 0.4 and s[1] > 0.9 and s[2] > 0.9 and s[4] < 0.1
    assert m.maps(["qqqidiotqqq" * 9])[0] @ z[0] > 0.02
    texts = [None, "", "i d i o t", "an idiot", "clean words alone " * 3000]
    x = m.pooled(texts)
    assert (x[:2] == 0).all() and abs(x[2, 0] - x[3, 0]) < 0.05 and x[4, 0] < 0.2


def test_words_are_remembered_by_letters(monkeypatch):
    """Words of the same letters are mapped once, common ones stay when rarer ones are forgotten, and maps are as before."""
    marks = ["^idiot", "^moron", "^worthless", "^window", "^report", "^garden"]
    rng, common = np.random.default_rng(9), [f"{w}{e}" for w in ("idiot", "window", "gardener", "reported") for e in ("", ".", ",", "!", "\u2019s")]
    texts = ["Window window, WINDOW. (window) w1ndow 12 34 x", *(" ".join([*common, *("".join(rng.choice(list("idotwn"), 8)) for _ in range(60)), str(i)]) for i in range(40))]
    want = [toxicity.WordMap(marks).pooled([t])[0] for t in texts]
    monkeypatch.setattr(toxicity, "REMEMBERED", 100)
    m, mapped, counted = toxicity.WordMap(marks), [], toxicity.against

    def against(words, landmarks):
        mapped.extend(w for w in words if w)
        return counted(words, landmarks)

    monkeypatch.setattr(toxicity, "against", against)
    got = np.stack([m.pooled([t])[0] for t in texts])
    assert np.abs(got - np.stack(want)).max() < 1e-5
    assert len(m.row.of) <= 200
    assert max(Counter(mapped)[toxicity.letters(w)] for w in common) == 1 and Counter(mapped)["^"] == 1
    assert (toxicity.WordMap(marks).pooled([None, ""]) == 0).all() and len(toxicity.WordMap(marks).pooled([])) == 0


def test_toxicity_edges_with_a_model(spark):
    """Null, empty, long and repeated texts, and clashing names, before a model that was fitted."""
    clean = ["the report of the garden was long and good", "we saw the window and the house by the river", "nothing to say about the weather today my friend"]
    rows = [(i, f"{clean[i % 3]} number {i}" + (" you idiot and moron" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(240)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model["landmarks"]
    texts = [None, "", "word " * 30_000 + "idiot moron", clean[0], clean[0], "what an 1d10t and a m.o.r.o.n he is", "\n\t"]
    df = spark.createDataFrame([(i, t, 7.0) for i, t in enumerate(texts)], "doc_id long, text string, __toxicity double")
    got = {r.doc_id: r.s for r in toxicity.score(df, model, name="s").collect()}
    assert len(got) == 7 and got[3] == got[4] < 0.5 < got[5] and got[0] == got[1] == got[6] < 0.5 and got[2] > 0.4
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.score(df, model, name="s").select("__toxicity").distinct().count() == 1


def test_sampling(spark, edge):
    df = spark.createDataFrame([(1, "hello wide world"), (2, None), (3, ""), (4, "tschüß 的 ☃")], "doc_id long, text string")
    rows = sampling.sample_segmentations(df, k=4).collect()
    again = sampling.sample_segmentations(df.repartition(3), k=4).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(tuple(r.ids))
    assert by[2] == by[3] == [()] and len(set(by[1])) == 4 and len(set(by[4])) == len(by[4])
    texts = spark.createDataFrame([(list(x),) for x in by[1]], "ids array<int>").select(sampling.decode("ids").alias("t")).collect()
    assert {r.t for r in texts} == {"hello wide world"}
    assert sampling.sample_segmentations(edge).count() >= 12 and sampling.sample_segmentations(edge.limit(0)).count() == 0


def all_paths(flat, node, head=(), weight=0.0):
    """Every path of a lattice from a node, by brute force: (edges, log probability)."""
    if node == 0:
        yield head, weight
        return
    for e in range(flat.first[node], flat.first[node + 1]):
        yield from all_paths(flat, int(flat.dest[e]), (*head, e), weight + float(flat.lp[e]))


@pytest.mark.parametrize("text", ["cat", "a b", "no|t"])
def test_sampling_law(text):
    """Ordered samples without replacement: p(a) for the first, p(b) / (1 - p(a)) for the second after a; all in the end."""
    lat = sampling.Lattices(tokens.tokenizer_path(sampling.MODEL))
    flat, roots = lat.build([lat.normalize(text)])
    prob = {(): 0.0}
    for root in roots[0].tolist():
        prob = {(*a, *b): p + q for a, p in prob.items() for b, q in all_paths(flat, root)}
    prob = {a: np.exp(p) for a, p in prob.items()}
    assert abs(sum(prob.values()) - 1) < 1e-9 and len(prob) > 3
    n = 20_000
    keys = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rounds, kappa = sampling.sample_top_k(flat, [roots[0]] * n, 2, keys)
    pick = [[tuple(p.edges[a : a + m].tolist()) for a, m in zip(p.start, p.size)] for p in rounds]
    assert np.allclose(np.exp(rounds[0].logp), [prob[x] for x in pick[0]]) and np.allclose(np.exp(rounds[1].logp), [prob[x] for x in pick[1]])
    assert (rounds[0].value >= rounds[1].value).all() and (rounds[1].value >= kappa).all()
    pairs = Counter(zip(*pick))
    assert all(a != b for a, b in pairs)
    for a, p in prob.items():
        for b, q in prob.items():
            want = p * q / (1 - p)
            if a != b and want > 1e-4:
                assert abs(pairs[a, b] / n - want) < 5 * np.sqrt(want / n) + 1e-4, (a, b)
    # the inclusion score, weighted by whether a path is in, estimates 1 for each path
    for a, p in prob.items():
        if p > 0.05:
            score = [-np.expm1(-np.exp(r.logp[i] - kappa[i])) for r, x in zip(rounds, pick) for i in range(n) if x[i] == a]
            assert abs(sum(1 / x for x in score) / n - 1) < 0.1
    if len(prob) < 200:
        few, _ = sampling.sample_top_k(flat, [roots[0]] * 3, len(prob) + 5, keys[:3])
        for d in range(3):
            found = [tuple(p.edges[p.start[i] : p.start[i] + p.size[i]].tolist()) for p in few for i in np.flatnonzero(p.docs == d)]
            assert len(found) == len(prob) and set(found) == set(prob)


def test_sampling_query(spark, sf_dir):
    """Two different segmentations of each text, both of which the library decodes to what its own normaliser makes of it."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.tokenizer_path(sampling.MODEL))
    texts = texts_of(spark, sf_dir)
    rows = QUERIES["op8_sentencepiece_sampling"](spark, sf_dir).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(texts)
    for d, x in by.items():
        assert sorted(r.nth for r in x) == list(range(len(x))) and (len(x) == 2 or len(texts[d]) < 2)
        assert len({r.ids_crc32 for r in x}) == len(x) and all(0 < r.inclusion <= 1 for r in x)
    docs = spark.createDataFrame([(d, t) for d, t in list(texts.items())[:60]], "doc_id long, text string")
    for r in sampling.sample_segmentations(docs).collect():
        (own,) = [x for x in by[r.doc_id] if x.nth == r.nth]
        assert (own.n_tokens, own.ids_crc32) == (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        assert sp.decode(list(r.ids)) == sp.decode(sp.encode(texts[r.doc_id])) and own.round_trip == (sp.decode(list(r.ids)) == texts[r.doc_id])


def test_embeddings_edges(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, []), (7, [1.0]), (8, [1.0, 0.01]), (9, [-1.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, component string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddup.near_vectors(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 8: (2, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 9: (0, 9)}
    assert embeddup.near_vectors(df.limit(0)).count() == 0


def test_code_bounds_hold():
    rng = np.random.default_rng(4)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.standard_normal((200, 32)), rng.standard_normal((200, 32))))
    p = embeddup.projections(32, 128)
    up, f, r = embeddup.encode(x, p)
    est, true = np.einsum("ij,ij->i", embeddup.decode(up, p), y) / f, np.einsum("ij,ij->i", x, y)
    assert (np.abs(est - true) <= r * np.sqrt(1 - true**2) + 1e-9).all() and abs((est - true).mean()) < 0.05


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "minhash_neardup", "secret_scan", "best_fit_packing"]
    rows = C.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns)
    assert 0 < rows.select("doc_id").distinct().count() < docs.count()
    for _, stage in C.STAGES[1:4]:
        assert stage(spark, docs.limit(0), sf_dir).columns == docs.columns


def test_pipeline_near_copies_of_one_bucket(spark, sf_dir, monkeypatch):
    """Copies in a large bucket that share no second band with their texts go all the same."""
    import corpus_pipeline as C

    def keys(sig):
        out = [np.array([xxhash.xxh3_64_intdigest(s, seed=b) for b in range(neardup.BANDS)], np.uint64).view(np.int64) & ~31 | np.arange(32) for s in sig]
        for k in out:
            k[0] = 64
        return pd.Series(out)

    keys.__annotations__ = {"sig": pd.Series, "return": pd.Series}
    monkeypatch.setattr(neardup, "_band_keys", keys)
    monkeypatch.setattr(neardup, "HOT", 10)
    rows = [(0, "the smallest id, another text")]
    for i in range(12):
        w = [f"w{i}x{j}" for j in range(100)]
        rows += [(2 * i + 1, " ".join(w)), (2 * i + 2, " ".join([*w[:50], "other", *w[51:]]))]  # 91 of 101 shingles shared
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in C.near_copies_out(spark, docs, sf_dir).collect()) == [0, *range(1, 25, 2)]
