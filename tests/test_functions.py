"""Values of single functions on edge rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventlens.functions import arrays as A
from eventlens.functions import datetime as D
from eventlens.functions import encode as N
from eventlens.functions import extract as X
from eventlens.functions import maps as M
from eventlens.functions import mathx as MX
from eventlens.functions import strings as S


@pytest.fixture(scope="module")
def of(spark):
    one = spark.range(1)
    return lambda *columns: list(one.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def L(x):
    return F.lit(x)


def test_strings(of):
    assert of(S.after(L("a-b-c"), "-"), S.after(L("a-b-c"), "-", -1), S.after(L("abc"), "-"), S.before(L("a-b-c"), "-"), S.between(L("x[1] y[2]"), "[", "]")) == ["b-c", "c", "", "a", "1"]
    assert of(S.slice_text(L("hello"), "1:3"), S.slice_text(L("hello"), "::-1"), S.slice_text(L("hello"), "-3:"), S.slice_text(L(""), "1:")) == ["el", "olleh", "llo", ""]
    assert of(S.like(L("a.txt"), "*.txt"), S.like(L("a.txt"), "?.tx"), S.ilike(L("A.TXT"), "a.*"), S.is_digit(L("")), S.is_digit(L("42"))) == [True, False, True, False, True]
    assert of(S.count(L("aaaa"), "aa"), S.edit_distance(L("kitten"), L("sitting")), S.or_empty(L(""))) == [2, 3, None]
    assert of(S.extract_regex(L("k=42;"), r"k=(\d+)"), S.extract_regex(L("none"), r"(\d+)"), S.replace_regex(L("ab"), "(a)(b)", "$2$1")) == ["42", "", "ba"]
    assert of(S.rjust(L("7"), 3, "0"), S.ljust(L("7"), 3), S.clip(L("--a b!!")), S.index_of(L("abc"), "c"), S.index_of(L("abc"), "x")) == ["007", "7  ", "a b", 2, -1]
    assert of(S.upper(L(None).cast("string")), S.contains(L(None).cast("string"), "a")) == [None, None]


def test_extract(of):
    text = L("from 10.0.0.1 and 999.1.1.1 to https://u@h.org:81/p?q=1. mail a@b.io")
    assert of(X.extract_ip(text), X.extract_ips(text), X.extract_url(text), X.extract_email(L("x a@b.io"))) == ["10.0.0.1", ["10.0.0.1"], "https://u@h.org:81/p?q=1", "a@b.io"]
    kv = X.parse_kv(L("a=1 bare b=2 a=3"))
    assert of(kv["a"], kv["b"]) == ["3", "2"]
    q = X.parse_query_params(L("?a=1&a=2&b=x+y%21"))
    assert of(q["a"], q["b"]) == ["1", "x y!"]


def test_arrays(of):
    a = F.array(L("10"), L("9"), L(None), L("b"))
    assert of(A.sorted_(a)) == [[None, "9", "10", "b"]]
    nums = F.array(L(1.0), L(2.0), L(3.0), L(4.0))
    assert of(A.mean(nums), A.variance(nums), A.percentile(nums, 50), A.min_(nums), A.slice_(nums, "::2")) == [2.5, 1.25, 2.5, 1.0, [1.0, 3.0]]


def test_maps(of):
    j = L('{"a":{"b":[1,2,{"c":null}]}}')
    assert of(M.get_path(j, "a.b[0]"), M.get_path(j, "a.b[-2]"), M.get_path(j, "x", "none"), M.has_path(j, "a.b[2].c")) == ["1", "2", "none", True]
    assert of(M.to_logfmt(F.create_map(L("k"), L("a b")))) == ['k="a b"']


def test_encodings(of):
    assert of(N.encode_b64(L("hé")), N.decode_b64(L("aMOp")), N.encode_hex(L("a")), N.encode_url(L("a b/ä")), N.decode_url(L("a%20b"))) == ["aMOp", "hé", "61", "a%20b%2F%C3%A4", "a b"]
    assert of(N.mask_ip(L("10.1.2.3")), N.mask_ip(L("10.1.2.3"), 2), N.mask_ip(L("nope")), N.is_private_ip(L("192.168.1.1")), N.is_in_cidr(L("10.2.3.4"), "10.0.0.0/8")) == ["10.1.2.0", "10.1.0.0", "nope", True, True]
    assert of(N.is_ipv4(L("1.2.3.256")), N.is_ipv6(L("::1"))) == [False, True]


def test_datetimes(of):
    at = dt.datetime(2024, 3, 5, 6, 7, 8)
    texts = ["2024-03-05T06:07:08Z", "1709618828", "05/Mar/2024:06:07:08 +0000", "Tue, 05 Mar 2024 06:07:08 +0000", "Tue Mar 5 06:07:08 2024", "2024-03-05T07:07:08+01:00"]
    got = of(*[F.date_format(D.parse_ts(L(t)), "yyyy-MM-dd HH:mm:ss") for t in texts])
    assert got == [str(at)] * len(texts)
    assert of(D.parse_ts(L("no time")), D.parse_ts(L("")), D.parse_ts(L(None).cast("string"))) == [None] * 3
    assert of(F.date_format(D.parse_ts(L("Tuesday 5 March 2024"), "%A %e %B %Y"), "yyyy-MM-dd")) == ["2024-03-05"]
    assert of(D.to_duration(L("1h 30m")), D.to_duration(L("x")), D.humanize_duration(L(90_061_001))) == [5_400_000_000_000, None, "1d 1h 1m 1s 1ms"]


def test_numbers(of):
    assert of(MX.to_int(L("1,234"), ","), MX.to_int(L(" 12 ")), MX.to_float(L("1.5")), MX.to_bool(L("yes")), MX.to_bool(L("maybe")), MX.to_int_or(L("x"), 7)) [0::2] == [1234, 1.5, None]
    assert of(MX.clamp(L(5), 1, 3), MX.status_class(L(404)), MX.status_class(L(99))) == [3, "4xx", "unknown"]


def test_rounding_keeps_the_sign_of_zero(spark, of, tmp_path):
    import duckdb

    from eventlens.plans.queries import ORACLE_SQL, QUERIES

    values = [-0.00001, 0.00001, -0.0, 1.005, -2.5, 0.285, 1e306, float("inf"), float("nan"), None]
    want = [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 2)", [v]).fetchone()[0] for v in values]
    assert repr(of(*[MX.round_(F.lit(v), 2) for v in values])) == repr(want)

    rows = [(1, [-0.00001, 0.6, 0.00001]), (2, [0.25, -1e-7, -0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = con.execute(ORACLE_SQL["array_higher_order"] + " ORDER BY vec_id")
    names = [d[0] for d in found.description]
    got = QUERIES["array_higher_order"](spark, str(tmp_path)).orderBy("vec_id").select(*names).collect()
    assert repr([tuple(r) for r in got]) == repr(found.fetchall())
