import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import cli
from ledgerline.functions.canon import UnsupportedType, canon
from ledgerline.operators import bounds, predicates
from ledgerline.plans import config as conf
from ledgerline.plans.compare import compare
from ledgerline.plans.config import Comparison, ConfigError
from ledgerline.plans.report import Report, plain, print_report, rendered
from ledgerline.sources import registry
from ledgerline.streaming.watch import watch

NO_WAIT = {"recheck_rounds": 0}


def run(spark, a, b, schema, pk=("id",), **how):
    now = how.pop("now", None)
    left, right = (x if hasattr(x, "columns") else spark.createDataFrame(x, schema) for x in (a, b))
    report = compare(lambda: left, lambda: right, Comparison("t", "a", "b", list(pk), **{**NO_WAIT, **how}), now)
    return {k[0] if len(k) == 1 else k: kind for k, kind in report.keys()}, report


def text(spark, value, kind, p=17):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", kind)]))
    return df.select(canon(F.col("v"), kind, p)).first()[0]


@pytest.mark.parametrize("value,kind,p,want", [
    (True, T.BooleanType(), 17, "1"), (None, T.BooleanType(), 17, None), (-7, T.LongType(), 17, "-7"),
    (Decimal("1.2300"), T.DecimalType(10, 4), 17, "1.23"), (Decimal("0E-10"), T.DecimalType(20, 10), 17, "0"), (Decimal("100"), T.DecimalType(10, 2), 17, "100"),
    (0.1, T.DoubleType(), 17, "0.10000000000000001"), (0.125, T.DoubleType(), 2, "0.12"), (-0.0, T.DoubleType(), 17, "-0"), (1e20, T.DoubleType(), 17, "1e+20"),
    (float("nan"), T.DoubleType(), 17, "nan"), (None, T.DoubleType(), 17, None), (0.5, T.FloatType(), 17, "0.5"),
    (dt.datetime(2024, 1, 2, 3, 4, 5, 678901), T.TimestampNTZType(), 17, "2024-01-02 03:04:05.678901"), (dt.date(2024, 2, 29), T.DateType(), 17, "2024-02-29"),
    (b"\x00\xff", T.BinaryType(), 17, "00ff"), ("café", T.StringType(), 17, "café"),
])
def test_canonical_text(spark, value, kind, p, want):
    assert text(spark, value, kind, p) == want


def test_zoned_timestamps_are_utc(spark):
    assert text(spark, dt.datetime(2024, 1, 2, 3, tzinfo=dt.timezone(dt.timedelta(hours=2))), T.TimestampType()) == "2024-01-02 01:00:00.000000"


def test_nested_types_need_excluding(spark):
    with pytest.raises(UnsupportedType):
        canon(F.col("v"), T.ArrayType(T.LongType()))


SCHEMA = "id long, name string"


@pytest.mark.parametrize("strategy", ["segment", "join"])
@pytest.mark.parametrize("a,b,want", [
    ([], [], {}), ([(1, "a")], [], {1: "missing"}), ([], [(1, "a")], {1: "extra"}), ([(1, "a")], [(1, "a")], {}), ([(1, "a")], [(1, "b")], {1: "changed"}),
    ([(1, None)], [(1, "a")], {1: "changed"}), ([(1, "")], [(1, None)], {1: "changed"}), ([(1, "a"), (2, "b")], [(1, "b"), (2, "a")], {1: "changed", 2: "changed"}),
    ([(None, "a"), (1, "a")], [(1, "a")], {}), ([(1, "a"), (1, "a")], [(1, "a")], {}),
])
def test_edges(spark, strategy, a, b, want):
    found, report = run(spark, a, b, SCHEMA, strategy=strategy)
    assert found == want and report.in_sync == (not want)


def test_duplicates_of_one_key_end(spark):
    found, _ = run(spark, [(1, "a")] * 20, [(1, "b")] * 20, SCHEMA, leaf_size=5, segment_fanout=2)
    assert found == {1: "changed"}


def test_counters_match_a_model_of_the_walk(spark):
    n, drift = 6000, {77, 3000, 5999}
    a = [(i, f"n{i}") for i in range(n)]
    b = [(i, "x" if i in drift else f"n{i}") for i in range(n)]
    found, report = run(spark, a, b, SCHEMA, segment_fanout=8, leaf_size=100)
    segments = rows = 0
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        segments += 1
        if not any(lo <= x < hi for x in drift):
            continue
        edges = bounds.boundaries(lo, hi, 8)
        if hi - lo > 100:
            todo += list(zip(edges, edges[1:]))
        else:
            rows += hi - lo
    assert found == dict.fromkeys(drift, "changed")
    assert (report.segments_scanned, report.rows_compared) == (segments, rows) and rows < 2000


@pytest.mark.parametrize("strategy", ["segment", "join"])
def test_composite_and_string_keys(spark, strategy):
    a = [(f"r{i % 5}", i, f"v{i}") for i in range(3000)]
    b = [x for x in a if x[1] != 40][:-1] + [("r9", 1, "new"), ("", 2, "low"), ("r2", 100000, "mid")]
    b[7] = (*b[7][:2], "other")
    want = {("r0", 40): "missing", a[-1][:2]: "missing", ("r9", 1): "extra", ("", 2): "extra", ("r2", 100000): "extra", b[7][:2]: "changed"}
    found, report = run(spark, a, b, "region string, id long, v string", ("region", "id"), leaf_size=50, strategy=strategy)
    assert found == want
    if strategy == "segment":
        assert report.rows_compared < 1500


def test_a_healthy_pair_is_one_segment_and_no_rows(spark):
    rows = [(i, f"n{i}") for i in range(500)]
    found, report = run(spark, rows, rows[::-1], SCHEMA, leaf_size=10)
    assert found == {} and (report.segments_scanned, report.rows_compared) == (1, 0)


@pytest.mark.parametrize("strategy", ["segment", "join"])
def test_keys_of_unlike_types_meet_as_numbers_and_times(spark, strategy):
    a = spark.sql("SELECT CAST(id AS DECIMAL(10,2)) AS id, 'x' AS v FROM range(40)")
    b = spark.sql("SELECT id, 'x' AS v FROM range(1, 41)")
    assert run(spark, a, b, None, strategy=strategy)[0] == {Decimal("0.00"): "missing", Decimal("40.00"): "extra"}
    a = spark.sql("SELECT DATE'2024-01-01' AS id, 1 AS v")
    b = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00' AS id, 1 AS v UNION ALL SELECT TIMESTAMP_NTZ'2024-01-01 01:00:00', 2")
    assert run(spark, a, b, None, strategy=strategy)[0] == {dt.datetime(2024, 1, 1, 1): "extra"}
    with pytest.raises(ValueError, match="cast one side"):
        run(spark, a, spark.sql("SELECT 'x' AS id, 1 AS v"), None, strategy=strategy)


@pytest.mark.parametrize("strategy", ["segment", "join"])
def test_names_with_dots_and_names_used_inside(spark, strategy):
    a = [(i, i % 7, f"v{i}") for i in range(300)]
    b = [(*x[:2], "other") if x[0] == 5 else x for x in a if x[0] != 9]
    for names in (("a.b", "place"), ("side", "key"), ("lo0", "kind_"), ("n0", "row s")):
        schema = T.StructType([T.StructField(n, T.LongType()) for n in names] + [T.StructField("open", T.StringType())])
        want = {(5, 5): "changed", (9, 2): "missing"}
        assert run(spark, a, b, schema, names, strategy=strategy, leaf_size=20)[0] == want
        one = {5: "changed", 9: "missing"}
        assert run(spark, a, b, schema, names[:1], strategy=strategy, leaf_size=20)[0] == one


def test_one_side_empty_counts_keys_not_rows(spark):
    rows = [(1, "a"), (1, "b"), (2, "c")]
    for a, b, kind in ((rows, [], "missing"), ([], rows, "extra")):
        found, report = run(spark, a, b, SCHEMA)
        assert found == {1: kind, 2: kind} and report.rows_compared == 2 and report.segments_scanned == 1


@pytest.mark.parametrize("seed", range(3))
def test_random_drift(spark, seed):
    r = random.Random(seed)
    ids = r.sample(range(-10**5, 10**5), 1500)
    a = {i: (r.choice([None, "x", "y"]), r.random(), r.random() < 0.5) for i in ids}
    b, want = dict(a), {}
    for i in r.sample(ids, 20):
        kind = r.choice(["missing", "extra", "changed"])
        if kind == "missing":
            del b[i]
            want[i] = kind
        elif kind == "changed":
            b[i] = ("z", *a[i][1:])
            want[i] = kind
        else:
            b[i + 2 * 10**5] = a[i]
            want[i + 2 * 10**5] = kind
    rows = [[(i, *v) for i, v in x.items()] for x in (a, b)]
    found, _ = run(spark, *rows, "id long, s string, f double, b boolean", segment_fanout=r.choice([5, 16]), leaf_size=r.choice([20, 100]))
    assert found == want


def test_star_takes_shared_columns_and_leaves_out_excluded(spark):
    a = spark.createDataFrame([(1, "a", "x", 1)], "ID long, name string, email string, only_a int")
    b = spark.createDataFrame([(1, "a", "y", 2)], "id long, NAME string, email string, only_b int")
    assert run(spark, a, b, None)[0] == {1: "changed"}
    assert run(spark, a, b, None, exclude_columns=["Email"])[0] == {}
    assert run(spark, a, b, None, compare_columns=["name"])[0] == {}


def test_lag(spark):
    now = dt.datetime(2026, 6, 20, 12, tzinfo=dt.timezone.utc)
    old, new = dt.datetime(2026, 6, 20, 10), dt.datetime(2026, 6, 20, 11, 59)
    schema = "id long, name string, at timestamp_ntz"
    a = [(1, "a", old), (2, "b2", new), (3, "c", new), (4, "d", old), (5, "e", old), (6, "n", None)]
    b = [(1, "a", old), (2, "b", old), (4, "x", old), (6, "m", None)]
    found, report = run(spark, a, b, schema, watermark_column="at", grace_seconds=300, now=now)
    assert found == {4: "changed", 5: "missing"} and report.cutoff == "2026-06-20T11:55:00+00:00"
    assert set(run(spark, a, b, schema)[0]) == {2, 3, 4, 5, 6}


def test_recheck_reads_anew(spark):
    states = [[(1, "a"), (2, "old"), (3, "old")], [(1, "a"), (2, "b"), (3, "old")]]
    slept = []
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], SCHEMA)
    calls = iter(states)
    report = compare(lambda: a, lambda: spark.createDataFrame(next(calls), SCHEMA), Comparison("t", "a", "b", ["id"], recheck_delay=5, recheck_rounds=1), sleep=slept.append)
    assert dict(report.keys()) == {(3,): "changed"} and slept == [5] and report.candidates_before_recheck == 2


def test_ranges_and_split_points(spark):
    rows = [(t, i) for t in "abc" for i in range(4)]
    df = spark.createDataFrame(rows, "t string, i long")
    got = predicates.in_range(df, ["t", "i"], ("a", 2), ("c", 1)).collect()
    assert sorted(map(tuple, got)) == [x for x in rows if ("a", 2) <= x < ("c", 1)]
    assert [tuple(r) for r in bounds.split_points(df, ["t", "i"], 3).collect()] == [rows[4], rows[8]]
    assert bounds.split_points(df.where("1 = 0"), ["t", "i"], 3).count() == 0
    assert bounds.pk_bounds(df.where("1 = 0"), ["t"]) is None


def test_range_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/t")
    df = predicates.in_range(spark.read.parquet(f"{tmp_path}/t"), ["id"], (5,), (9,))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,5)" in plan.replace("...", "") or "PushedFilters: [IsNotNull(id), GreaterThanOrEqu" in plan
    assert df.count() == 4


def test_closed_form_child_agrees_with_boundaries(spark):
    r = random.Random(3)
    for wide in (False, True):
        lo = r.randrange(-1000, 1000)
        hi, n = lo + r.randrange(1, 300), r.randrange(2, 20)
        a, b = bounds.child(F.col("id"), F.lit(lo), F.lit(hi), n, wide)
        for k, x, y in spark.range(lo, hi).select("id", a, b).collect():
            edges = bounds.boundaries(lo, hi, n)
            i = max(j for j, e in enumerate(edges) if e <= k)
            assert (x, y) == (edges[i], edges[i + 1])


def raw(**more):
    return {"connections": {"source": {"driver": "parquet", "path": "${LEDGER_A}"}, "target": {"driver": "parquet", "path": "${LEDGER_B}"}},
            "comparisons": [{"name": "orders", "source_table": "t", "target_table": "t", "primary_key": "id", "recheck": {"rounds": 0}, **more}]}


def test_configuration(monkeypatch):
    monkeypatch.setenv("LEDGER_A", "/a")
    monkeypatch.setenv("LEDGER_B", "/b")
    c = conf.parse(raw(grace="1.5h", watermark_column="at"))
    assert c.source.params == {"path": "/a"} and c.comparisons[0].grace_seconds == 5400 and c.comparisons[0].segment_fanout == 16
    for bad in ({"segment_fanout": 1}, {"segment_fanout": "abc"}, {"leaf_size": 0}, {"recheck": {"rounds": -1}}, {"grace": "5m"}, {"grace": "x"}, {"grace": -1}, {"primary_key": []}, {"name": None}, {"compare_columns": 3}):
        with pytest.raises(ConfigError):
            conf.parse(raw(**bad))
    monkeypatch.delenv("LEDGER_B")
    with pytest.raises(ConfigError, match="LEDGER_B"):
        conf.parse(raw())
    for bad in (None, {}, {"connections": {}}, {**raw(), "comparisons": []}):
        with pytest.raises(ConfigError):
            conf.parse(bad)


def test_registry(spark):
    assert {"memory", "parquet", "csv", "json", "orc", "table", "jdbc", "postgres", "duckdb", "snowflake"} <= set(registry.available_drivers())
    with pytest.raises(KeyError, match="parquet"):
        registry.source_class("nope")
    memory = registry.source_class("memory")(spark, tables={"t": [{"B": 1, "a": 2}]})
    assert memory.columns("t") == ["a", "b"]
    with pytest.raises(KeyError):
        memory.load("u")


def test_reports(spark, capsys):
    drift = spark.createDataFrame([(i, "missing") for i in range(25)], "id long, kind string")
    report = Report("orders", drift, ["id"], 9, 1, 25)
    first, table = rendered(report).splitlines()[:2]
    assert first == "orders: DRIFT, 25 keys differ" and table.split() == ["missing", "25", *map(str, range(20)), "..."]
    loaded = json.loads(rendered(report, "json"))
    assert list(loaded) == sorted(loaded) and json.loads(rendered(Report("none"), "json"))["drift_keys"] == []
    assert loaded["drift_total"] == 25 and loaded["drift_by_kind"] == {"missing": 25, "extra": 0, "changed": 0} and loaded["drift_keys"][0] == {"key": [0], "kind": "missing"}
    assert print_report(Report("x", error="boom")) == 2 and "x: FAILED (boom)" in capsys.readouterr().out
    with pytest.raises(ValueError):
        print_report(report, "xml")
    assert [plain(v) for v in (float("nan"), Decimal("1.50"), dt.date(2024, 1, 2), b"\xff", True, None)] == ["nan", "1.5", "2024-01-02", "ff", True, None]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("LEDGER_A", f"{tmp_path}/a")
    monkeypatch.setenv("LEDGER_B", f"{tmp_path}/b")
    spark.range(50).withColumn("v", F.col("id") * 2).write.parquet(f"{tmp_path}/a/t.parquet")
    spark.range(50).withColumn("v", F.col("id") * 2).write.parquet(f"{tmp_path}/b/t.parquet")
    path = tmp_path / "c.yaml"
    import yaml

    path.write_text(yaml.safe_dump(raw()))
    assert cli.main(["run", "-c", str(path)]) == 0
    spark.range(51).where("id <> 20").withColumn("v", F.when(F.col("id") == 10, 0).otherwise(F.col("id") * 2)).write.mode("overwrite").parquet(f"{tmp_path}/b/t.parquet")
    capsys.readouterr()
    assert cli.main(["run", "-c", str(path), "--format", "json"]) == 1
    assert [(k["key"], k["kind"]) for k in json.loads(capsys.readouterr().out)["drift_keys"]] == [([10], "changed"), ([20], "missing"), ([50], "extra")]
    assert cli.main(["run", "-c", str(path), "--only", "x"]) == 3 and cli.main(["run", "-c", str(tmp_path / "none")]) == 3
    two = raw()
    two["comparisons"].insert(0, {**two["comparisons"][0], "name": "gone", "source_table": "gone"})
    path.write_text(yaml.safe_dump(two))
    assert cli.main(["run", "-c", str(path)]) == 2
    out = capsys.readouterr().out
    assert "gone: FAILED" in out and "orders: DRIFT" in out
    assert cli.main(["init"]) == 0 and "connections" in capsys.readouterr().out and cli.main([]) == 2


def test_watch(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/changes")
    a, b = (spark.range(n).withColumn("v", F.lit(1)) for n in (5, 4))
    told = []
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/changes")
    watch(stream, lambda: a, lambda: b, Comparison("t", "a", "b", ["id"], **NO_WAIT), lambda n, r: told.append(dict(r.keys()))).awaitTermination(60)
    assert told == [{(4,): "missing"}]
