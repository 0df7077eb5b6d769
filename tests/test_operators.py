"""Steps over small inputs with an arrival order, and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventlens.operators import drain as DR
from eventlens.operators import events as EV
from eventlens.operators import metrics as ME
from eventlens.operators import outputs as O
from eventlens.operators import spans as SP
from eventlens.operators import state as ST
from eventlens.operators import timeargs
from eventlens.plans.pipeline import Events, load_config, run_spec
from eventlens.sources import formats as P
from eventlens.sources import lines as LN
from eventlens.streaming import live


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_field_spans_interleaved(spark):
    df = frame(spark, [(i, v) for i, v in enumerate(["req-1", "req-2", "req-1", "req-1"])], "seq long, id string")
    assert sorted(r.span_size for r in SP.close_spans(SP.field_spans(df, "id", "seq")).collect()) == [1, 1, 2]


def test_idle_spans(spark):
    at = [dt.datetime(2024, 1, 1, 0, 0, s) for s in (10, 5, 20)]
    df = frame(spark, list(enumerate(at)), "seq long, ts timestamp")
    assert sorted(r.span_size for r in SP.close_spans(SP.idle_spans(df, "ts", "seq", 5)).collect()) == [1, 2]


def test_context_and_take(spark):
    df = frame(spark, [(i, "error" if i == 3 else "info") for i in range(8)], "seq long, level string")
    rows = EV.context(df, F.col("level") == "error", "seq", before=1, after=2).orderBy("seq").collect()
    assert [(r.seq, r.context_type) for r in rows] == [(2, "before"), (3, "match"), (4, "after"), (5, "after")]
    assert [r.seq for r in EV.take(df, 2, "seq").orderBy("seq").collect()] == [0, 1]


def test_empty_inputs(spark):
    df = frame(spark, [], "seq long, ts timestamp, level string, v double")
    assert EV.context(df, "v > 1", "seq", 1, 1).count() == 0
    assert SP.close_spans(SP.count_spans(df, "seq", 3)).count() == 0
    assert LN.head(df, "seq", 3).count() == 0
    assert SP.idle_spans(df, "ts", "seq", 3).count() == 0


def test_parsers_on_bad_lines(spark):
    df = frame(spark, [("",), (None,), ("<999>bad",), ("garbage {",)], "line string")
    out = df.select(P.syslog(F.col("line")).alias("s"), P.combined(F.col("line")).alias("c"), P.cef(F.col("line")).alias("e"), P.json(F.col("line"), "a long").alias("j")).collect()
    assert all(r.c is None and r.e is None for r in out)
    assert P.detect('{"a": 1}') == "json" and P.detect("CEF:0|a|b|c|d|e|f|") == "cef" and P.detect("plain words") == "line"


def test_multiline_and_sections(spark):
    df = frame(spark, list(enumerate(["start a", "  more", "start b", "", "  tail"])), "seq long, line string")
    assert [r.line for r in LN.multiline(df, "line", "seq", "indent", joiner="+").orderBy("seq").collect()][0] == "start a+  more"
    assert [r.seq for r in LN.sections(df, "line", "seq", start="b$").orderBy("seq").collect()] == [2, 3, 4]


def test_read_lines(spark, tmp_path):
    """Folders, globs and names with blanks; files keep their order and true names, lines their numbers, split or not."""
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.log").write_text("one\ntwo\n")
    (tmp_path / "d" / "b c.log").write_text("".join(f"line {i}\n" for i in range(6)))
    (tmp_path / "z.log").write_text("three\n")
    rows = LN.read_lines(spark, [str(tmp_path / "z.log"), str(tmp_path / "d"), str(tmp_path / "none.log")]).orderBy("_seq").collect()
    assert [(r.value, r._file.rsplit("/", 1)[1], r._line_num) for r in rows] == [("three", "z.log", 1), ("one", "a.log", 1), ("two", "a.log", 2), *[(f"line {i}", "b c.log", i + 1) for i in range(6)]]
    by_name = LN.read_lines(spark, [str(tmp_path / "z.log"), str(tmp_path / "d" / "*.log")], "name").orderBy("_seq").collect()
    assert [r.value for r in by_name] == ["one", "two", *[f"line {i}" for i in range(6)], "three"]
    with pytest.raises(FileNotFoundError):
        LN.read_lines(spark, [str(tmp_path / "none.log")], strict=True)
    assert LN.read_lines(spark, [str(tmp_path / "none.log")]).count() == 0
    big = tmp_path / "big.log"
    big.write_text("".join(f"{i} {'x' * (i % 50)}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = LN.read_lines(spark, [str(big), str(tmp_path / "z.log")])
        assert df.rdd.getNumPartitions() >= 4
        assert [r.value.split(" ")[0] for r in df.where("_file like '%big.log'").orderBy("_line_num").collect()] == [str(i) for i in range(5000)]
        assert df.agg(F.max("_line_num")).first()[0] == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_read_compressed(spark, tmp_path):
    import gzip

    import zstandard

    text = "".join(f"line {i}\r\n" for i in range(25)) + "last\x0bpart"
    (tmp_path / "a").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "b").write_bytes(zstandard.ZstdCompressor().compress(text.encode()))
    (tmp_path / "c").write_bytes(text.encode())
    rows = LN.read_compressed(spark, str(tmp_path), batch=7).collect()
    for name in "abc":
        own = sorted((r._line_num, r.value) for r in rows if r._file.endswith("/" + name))
        assert own == [(i + 1, f"line {i}") for i in range(25)] + [(26, "last\x0bpart")]


@pytest.mark.parametrize("seq", ["id", "id * 1000003 % 7919 * 1000000", "-id * id", "double(id) / 7"])
def test_running_values_on_any_order(spark, seq):
    """Dense, sparse, negative and fractional orders give the same sums, cut into many parts."""
    df = spark.range(3000).selectExpr(f"{seq} as seq", "id", "if(id % 3 = 0, id, null) as v").dropDuplicates(["seq"])
    rows = df.orderBy("seq").collect()
    got = LN.running_sum(df, F.col("id"), "seq", "s", LN.parts(df, "seq", 100)).orderBy("seq").collect()
    total = 0
    for r, g in zip(rows, got):
        total += r.id
        assert g.s == total
    last, want = None, []
    for r in rows:
        want.append(last)
        last = r.v if r.v is not None else last
    assert [r.p for r in SP.before_last(df, "seq", "p", F.col("v"), cut=LN.parts(df, "seq", 100)).orderBy("seq").collect()] == want


def test_merge_sorted_refuses(spark):
    good = frame(spark, [(i, dt.datetime(2024, 1, 1, 0, 0, i)) for i in range(3)], "_line long, ts timestamp")
    bad = frame(spark, [(0, dt.datetime(2024, 1, 1, 0, 0, 9)), (1, dt.datetime(2024, 1, 1))], "_line long, ts timestamp")
    assert [r._line for r in LN.merge_sorted([good, good], "ts", "_line").collect()] == [0, 0, 1, 1, 2, 2]
    with pytest.raises(Exception, match="not sorted"):
        LN.merge_sorted([good, bad], "ts", "_line").collect()
    with pytest.raises(ValueError):
        LN.merge_sorted([good, good.limit(0)], "ts", "_line")


def test_state_api_and_streams(spark, sf_dir, tmp_path):
    s = ST.State()
    assert s["x"] is None and s.get("x", 5) == 5 and s.is_empty() and not s.contains("x")
    s.set("x", 1)
    s.fill_with({"x": 9, "y": 2})
    s.mixin({"y": 3})
    s += {"z": 4}
    assert (s + {"w": 0}).to_map() == {"x": 1, "y": 3, "z": 4, "w": 0} and len(s) == 3 and list(s.keys()) == ["x", "y", "z"] and list(s.values()) == [1, 3, 4]
    assert s.remove("x") == 1 and s.remove("x") is None
    s.clear()
    assert s.to_map() == {}

    def count(state, event):
        state.set("n", state.get("n", 0) + 1)
        return {"user_id": event["user_id"], "n": state["n"]}

    src = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    for k in (0, 1):
        src.where(f"event_id % 2 = {k}").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    src.limit(0).write.parquet(str(tmp_path / "in"))
    for k in (0, 1):
        for i, f in enumerate((tmp_path / f"in{k}").glob("*.parquet")):
            f.rename(tmp_path / "in" / f"p{k}{i}.parquet")
    stream = live.stateful(live.read_parquet_stream(spark, str(tmp_path / "in"), src.schema), "user_id", "event_id", count, "user_id long, n long")
    most = {r.user_id: r.n for r in live.run_once(stream, "t_state").groupBy("user_id").agg(F.max("n").alias("n")).collect()}
    assert most == {r.user_id: r["count"] for r in src.groupBy("user_id").count().collect()}
    assert ST.stateful(src.limit(0), "event_id", count, "user_id long, n long", by=["user_id"]).count() == 0


def test_reports(spark):
    df = frame(spark, [(i, f"user {i} logged in from 10.0.0.{i}", "a" if i % 3 else "b") for i in range(6)], "_seq long, line string, kind string")
    m = ME.Metrics(df).track("n", "inc").track("kinds", "freq", "kind")
    assert m.text("json") == '{"kinds": {"a": 4, "b": 2}, "n": 6}' and m.text("short") == "kinds (2 entries):\n  a = 4\n  b = 2\nn = 6\n"
    assert DR.report(df, "line") == "templates (1 items):\n  6  user <num> logged in from <ipv4>" and DR.report(df.limit(0), "line") == "No templates found"
    assert "sample: user 0 logged in from 10.0.0.0" in DR.report(df, "line", "full", "_seq")
    saved, defaults = load_config('[aliases]\nerrors = [["levels", [["error"]]]]\n[defaults]\nformat = json\n')
    assert saved == {"errors": [["levels", [["error"]]]]} and defaults == {"format": "json"}
    assert O.hide(df).count() == 0


def test_includes(spark, tmp_path):
    (tmp_path / "steps.json").write_text('[["filter", ["v > 2"]]]')
    df = frame(spark, [(i, float(i)) for i in range(6)], "_seq long, v double")
    out = run_spec(Events(df), [{"include": str(tmp_path / "steps.json")}, ["take", [2]]])
    assert [r.v for r in out.df.orderBy("_seq").collect()] == [3.0, 4.0]


def test_time_arguments():
    now = dt.datetime(2024, 5, 6, 12, tzinfo=dt.UTC)
    assert timeargs.resolve("1h", now) == now - dt.timedelta(hours=1)
    assert timeargs.resolve("+30m", now) == now + dt.timedelta(minutes=30)
    assert timeargs.resolve_range("today", "since+2h", now)[1].hour == 2


def test_outputs(spark, tmp_path):
    df = frame(spark, [("a b", None, 1)], "msg string, gone string, n int")
    row = df.select(O.as_json(df).alias("j"), O.as_logfmt(df).alias("l"), O.as_csv(df, ["msg", "gone", "n"]).alias("c")).first()
    assert '"n":1' in row.j and "gone" not in row.l and row.c == "a b,,1"


def test_fluent_steps(spark):
    df = frame(spark, [(i, "info" if i % 2 else "error", float(i)) for i in range(10)], "_seq long, level string, v double")
    out = run_spec(Events(df), '[["levels", [["error"]]], ["filter", ["v > 2"]], ["take", [2]]]')
    assert [r.v for r in out.df.orderBy("_seq").collect()] == [4.0, 6.0]


def test_streams(spark, sf_dir, tmp_path):
    src = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.coalesce(1).orderBy("ts").write.parquet(str(tmp_path / "in"))
    stream = live.read_parquet_stream(spark, str(tmp_path / "in"), src.schema)
    spans = live.time_spans(stream, "ts", "1 day", "1 hour", F.count("*").alias("n"))
    got = {r.window.start: r.n for r in live.run_once(spans, "t_spans", "complete").collect()}
    want = {r.window.start: r.n for r in src.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).collect()}
    assert got == want
    changes = live.field_spans(live.read_parquet_stream(spark, str(tmp_path / "in"), src.schema), "user_id", "event_type", "event_id")
    rows = live.run_once(changes, "t_changes").collect()
    assert rows and all(r["size"] >= 1 for r in rows)


@pytest.mark.parametrize("name", ["track_cardinality", "cardinality_against_exact"])
def test_one_sketch_for_the_whole_stream(spark, sf_dir, name):
    from eventlens.plans.queries import QUERIES

    physical = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    kept = [line for line in physical.splitlines() if "Aggregate(keys=[user_id" in line]
    assert kept and not any("approx_count_distinct" in line for line in kept)


def test_cef_runs_its_pattern_once(spark):
    lines = [
        r"Sep 19 host CEF:0|v\|w|p\\q|1.0|100|worm|10|src=10.0.0.1 note=a\=b src=::1 bare", "CEF:0|||||||", "CEF:0|v|p|1|2|3", "x CEF:1|a\uf8f1b|\uf8f1|c|d|e|f|k=\uf8f1 l=", "CEF:0|a\uf8f1|b", "", None,
    ]
    df = frame(spark, list(enumerate(lines)), "seq long, line string").select("seq", P.cef("line").alias("r")).orderBy("seq")
    assert [r.r and (*r.r[:7], r.r.extension) for r in df.collect()] == [
        ("0", "v|w", "p\\q", "1.0", "100", "worm", "10", {"src": "::1", "note": "a=b"}), ("0", *[""] * 6, {}), None, ("1", "a\uf8f1b", "\uf8f1", "c", "d", "e", "f", {"k": "\uf8f1", "l": ""}), None, None, None,
    ]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("CEF:(") <= 10  # one replacement, and one match and eight extractions for lines with the mark


def test_syslog_runs_its_patterns_once(spark):
    mark = "\uf8f1"
    lines = [
        '<165>1 2003-10-11T22:14:15.003Z h app 7 ID1 [ex@1 iut="3" e="a\\"]b"] one two', "<0>1 - - - - - -", "<192>1 - h a - - - m", f"<34>1 - h{mark} a x - - m{mark}{mark}",
        "<34>Oct 11 22:14:15 h su[12]: it failed", "2024-01-02T03:04:05Z h su: ", f"Oct  1 22:14:15 {mark} su: a{mark}", "<200>Oct 11 22:14:15 h su: m", "", None,
    ]
    df = frame(spark, list(enumerate(lines)), "seq long, line string").select("seq", P.syslog("line").alias("r")).orderBy("seq")
    assert [r.r and tuple(r.r) for r in df.collect()] == [
        (165, 20, 5, "notice", 1, "2003-10-11T22:14:15.003Z", "h", "app", 7, "ID1", "one two"), (0, 0, 0, "emerg", 1, None, None, None, None, None, ""), None,
        (34, 4, 2, "crit", 1, None, f"h{mark}", "a", None, None, f"m{mark}{mark}"), (34, 4, 2, "crit", None, "Oct 11 22:14:15", "h", "su", 12, None, "it failed"),
        (None, None, None, None, None, "2024-01-02T03:04:05Z", "h", "su", None, None, ""), (None, None, None, None, None, "Oct  1 22:14:15", mark, "su", None, None, f"a{mark}"), None, None, None,
    ]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<(") <= 20  # for each form one replacement, and a match and an extraction a group for lines with the mark
