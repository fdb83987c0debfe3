import datetime as dt
import glob
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrubline import operators as ops
from scrubline import session, streaming
from scrubline.functions import stats
from scrubline.operators import checks
from scrubline.plans import profile, recipe, report
from scrubline.session import cut_lineage
from scrubline.sources import readers, writers
from scrubline.streaming import clean_stream, fit_steps

CSV = '''id,amount,day,name,flag,padded,gaps,big,empty
1,5,2024-01-01, bob,True,  1,1,9223372036854775808,
2,N/A,01-02-2024,"O""Neil, x",false,2 ,,1,
3,-7.5,invalid_date,,TRUE, 3,3,2,NA

4,1e3, NA,null,False,4,4,3,None
'''


@pytest.mark.parametrize("row_id", [False, True])
def test_csv(spark, tmp_path, row_id):
    (tmp_path / "t.csv").write_text(CSV)
    df = readers.read_csv(spark, str(tmp_path / "t.csv"), row_id=row_id)
    assert dict(df.dtypes) | {"_row_id": "bigint"} == {
        "id": "bigint", "amount": "double", "day": "string", "name": "string", "flag": "boolean",
        "padded": "bigint", "gaps": "bigint", "big": "double", "empty": "double", "_row_id": "bigint"}
    rows = df.orderBy("id").collect()
    assert [r["amount"] for r in rows] == [5.0, None, -7.5, 1000.0]
    assert [r["name"] for r in rows] == [" bob", 'O"Neil, x', None, None]
    assert [r["day"] for r in rows] == ["2024-01-01", "01-02-2024", "invalid_date", " NA"]
    assert [r["flag"] for r in rows] == [True, False, True, False]
    assert [r["padded"] for r in rows] == [1, 2, 3, 4]
    if row_id:
        assert [r["_row_id"] for r in rows] == [0, 1, 2, 3]


def test_truth_values_with_gaps_stay_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,True\n2,\n")
    assert dict(readers.read_csv(spark, str(tmp_path / "t.csv")).dtypes)["b"] == "string"


def test_csv_rows_are_numbered_across_splits_and_files(spark, tmp_path):
    for part in range(3):
        lines = "".join(f"{part * 2000 + i}\n" for i in range(2000))
        (tmp_path / f"part{part}.csv").write_text("n\n" + lines)
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        df = readers.read_csv(spark, str(tmp_path), row_id=True)
        assert df.where("n <> _row_id").count() == 0 and df.count() == 6000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)


@pytest.mark.parametrize("files", [0, 200_000])
def test_parquet_rows_are_numbered_in_file_order(spark, tmp_path, monkeypatch, files):
    monkeypatch.setattr(readers, "BROADCAST_FILES", files)
    for part in range(4):
        pd.DataFrame({"n": np.arange(part * 100, part * 100 + 100 + (part == 3) * 7),
                      "x": [math.nan] + [1.0] * (99 + (part == 3) * 7)}).to_parquet(tmp_path / f"p{part}.parquet")
    df = readers.read_parquet(spark, str(tmp_path), row_id=True)
    assert df.where("n <> _row_id").count() == 0 and df.count() == 407
    assert df.where("x is null").count() == 4


def test_written_tables_read_back(spark, table, tmp_path):
    df = table("a string, b double, t string", [(" é\"q\" ", 1.5, "x,y"), ("", None, "l\nm"), (None, -2.0, "ü")])
    plain = df.drop("_row_id")
    path = writers.export_to_parquet(df, output_dir=str(tmp_path))
    assert sorted(map(str, spark.read.parquet(path).collect())) == sorted(map(str, plain.collect()))
    path = writers.export_to_json(df, output_dir=str(tmp_path))
    lines = [json.loads(x) for f in glob.glob(f"{path}/part*") for x in open(f, encoding="utf-8")]
    assert {"a": None, "b": -2.0, "t": "ü"} in lines and len(lines) == 3
    path = writers.export_to_csv(df, output_dir=str(tmp_path))
    back = readers.read_csv(spark, path, multiline=True).orderBy("t").collect()
    assert sorted(map(str, back)) == sorted(map(str, df.selectExpr("nullif(a, '') a", "b", "t").collect()))


def test_written_reports(spark, table, tmp_path):
    quality = report.run_quality_checks(table("a string, b double", [(" é", float(i)) for i in range(12)]))
    paths = writers.export_quality(spark, quality, str(tmp_path))
    text = ["".join(open(f, encoding="utf-8").read() for f in glob.glob(f"{p}/part*")) for p in paths]
    assert json.loads(text[0]) == quality.report
    assert pd.read_csv(glob.glob(f"{paths[1]}/part*")[0])["column"].tolist() == [r["column"] for r in quality.summary]
    assert text[2].strip() == quality.text


def test_comparison(spark, table, tmp_path):
    df = table("a double, b string", [(1.0, "x"), (None, "y")])
    path = writers.export_comparison(df, ops.drop_rows_with_nulls(df, "a").drop("b"), output_dir=str(tmp_path))
    rows = spark.read.option("header", True).csv(f"{path}/Summary").collect()
    assert [(r["Metric"], r["Value"]) for r in rows] == [
        ("Original Rows", "2"), ("Cleaned Rows", "1"), ("Rows Changed", "1"), ("Original Columns", "2"),
        ("Cleaned Columns", "1")]
    assert spark.read.parquet(f"{path}/Original").count() == 2
    assert spark.read.parquet(f"{path}/Cleaned").count() == 1


class _Session:
    """Only what decides where scratch data goes."""

    def __init__(self, master, folder):
        settings = {"spark.checkpoint.dir": folder}
        self.conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: settings.get(k) or d)})
        context = {"master": master, "applicationId": "app", "getConf": lambda self: settings}
        self.sparkContext = type("Context", (), context)()


def test_scratch_comes_from_the_named_folder():
    assert session.scratch_path(_Session("yarn", "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    assert session.shared_folder(_Session("local[2]", None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(_Session("yarn", None))


# ---- streams ----

STEPS = [
    {"tool_name": "trim_spaces", "arguments": {"column": "s"}},
    {"tool_name": "fill_nulls", "arguments": {"column": "x", "method": "median"}},
    {"tool_name": "remove_outliers", "arguments": {"column": "x", "action": "clip"}},
    {"tool_name": "scale_numeric", "arguments": {"column": "x", "method": "minmax"}},
    {"tool_name": "bin_numeric", "arguments": {"column": "x", "bins": 4, "new_column": "b"}},
    {"tool_name": "extract_date_part", "arguments": {"column": "d", "part": "weekday", "new_column": "w"}},
]
TYPES = {"s": "string", "x": "numeric", "d": "string"}


@pytest.fixture
def streamed(spark, table, tmp_path):
    rows = [(f" n{i} ", None if i % 6 == 0 else float(i * i), f"2024-01-{i + 1:02d}") for i in range(28)]
    df = table("s string, x double, d string", rows)
    df.write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_fitted_steps_clean_a_stream(spark, streamed, tmp_path):
    batch, stream = streamed
    fitted = json.loads(json.dumps(fit_steps(batch, STEPS, TYPES)))
    query = (
        clean_stream(stream, fitted, TYPES).writeStream.format("memory").queryName("cleaned")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    want, _, errors = recipe.apply_steps(batch, STEPS, TYPES)
    assert not errors
    assert sorted(map(str, spark.table("cleaned").collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("step", [*STEPS[1:], {"tool_name": "deduplicate_rows", "arguments": {}},
                                  {"tool_name": "fill_nulls", "arguments": {"column": "x", "method": "ffill"}}])
def test_unfitted_steps_refuse_a_stream(streamed, step):
    with pytest.raises(ValueError):
        clean_stream(streamed[1], [step], TYPES)


# ---- profile ----


def test_describe_like_pandas(table):
    given = [3.0, 1.0, None, 10.0, 2.5]
    want = pd.Series(given).describe()
    got = {r["statistic"]: r["value"] for r in profile.describe_column(table("x double", given), "x").collect()}
    assert got == pytest.approx(want.to_dict())


def test_describe_text_and_times(table):
    df = table("s string", ["b", "a", "a", None, "b", "a"])
    got = [(r["statistic"], r["value"]) for r in profile.describe_column(df, "s").collect()]
    assert got == [("count", "5"), ("unique", "2"), ("top", "a"), ("freq", "3")]
    times = table("s string", ["2024-01-01", "2024-01-03", None]).selectExpr("cast(s as timestamp_ntz) t", "_row_id")
    got = {r["statistic"]: r["value"] for r in profile.describe_column(times, "t").collect()}
    assert got["count"] == "2" and got["mean"] == got["50%"] == "2024-01-02 00:00:00"
    assert got["max"] == "2024-01-03 00:00:00"
    empty = {r["statistic"]: r["value"] for r in profile.describe_column(df.where("s is null"), "s").collect()}
    assert empty == {"count": "0", "unique": "0", "top": None, "freq": None}


def test_distribution_of_many_values_like_pandas(table):
    rng = np.random.default_rng(1)
    given = [float(v) for v in rng.normal(0, 3, 500)] + [40.0]
    want = pd.Series(given).value_counts(bins=20, sort=False)
    rows = profile.numeric_distribution(table("x double", given), "x").orderBy("position").collect()
    assert [r["count"] for r in rows] == want.tolist()
    assert [r["bucket"] for r in rows] == [str(i) for i in want.index]


def test_distribution_of_few_values(table):
    rows = profile.numeric_distribution(table("x bigint", [3, 1, 1, None]), "x").orderBy("position").collect()
    assert [(r["bucket"], r["count"]) for r in rows] == [("1", 2), ("3", 1)]


def test_correlation_like_pandas(table):
    rng = np.random.default_rng(4)
    data = pd.DataFrame({"a": rng.normal(size=50), "b": rng.normal(size=50), "k": 2.0})
    data["c"] = data["a"] * 2 + data["b"]
    data.loc[::7, "b"] = None
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in data.itertuples(index=False)]
    df = table("a double, b double, k double, c double", rows)
    want = data.corr().reset_index().melt("index")
    got = profile.correlation_matrix(df).toPandas()
    assert got["index"].tolist() == want["index"].tolist() and got["variable"].tolist() == want["variable"].tolist()
    assert got["value"].astype(float).to_numpy() == pytest.approx(want["value"].to_numpy(), nan_ok=True)
    with pytest.raises(ValueError):
        profile.correlation_matrix(df.select("a"))


def test_box_plot_scatter_and_top_values(table):
    df = table("x double, y bigint, s string", [(float(i), i % 3, f"v{i % 30:02d}") for i in range(100)])
    assert tuple(profile.box_plot_statistics(df, "x").first()) == (0.0, 24.75, 49.5, 74.25, 99.0)
    assert profile.scatter_data(df, "x", "y").count() == 100
    assert 0 < profile.scatter_data(df, "x", "y", fraction=0.5).count() < 100
    top = profile.categorical_distribution(df, "s").collect()
    assert len(top) == 20 and (top[0]["value"], top[0]["count"]) == ("v00", 4)
    with pytest.raises(ValueError):
        profile.scatter_data(df, "x", "s")


def test_plans_stay_narrow(spark):
    """A two-column question reads two columns; cleaning adds no shuffle."""
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    cleaned = ops.round_numeric(ops.fill_nulls(df, "l_tax", "median"), "l_tax", 1).where("l_quantity > 40")
    plan = cleaned.select("l_tax")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan
    assert "GreaterThan(l_quantity,40.0)" in plan


def test_scans_share_one_job(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-scan", "")
    checks.scan_columns(df)
    jobs = tracker.getJobIdsForGroup("one-scan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 1 <= len(jobs) <= 2


def test_wide_csv(spark, tmp_path):
    lines = [",".join(f"c{i}" for i in range(600))]
    lines += [",".join(f"{r}" if i % 3 else f"{r}.5" if i % 2 else "x" for i in range(600)) for r in range(50)]
    (tmp_path / "wide.csv").write_text("\n".join(lines))
    types = readers.read_csv(spark, str(tmp_path / "wide.csv")).dtypes
    assert types == [(f"c{i}", "bigint" if i % 3 else "double" if i % 2 else "string") for i in range(600)]


def _most_common(rows, column):
    values = [r[column] for r in rows if r[column] is not None]
    return min(((-values.count(v), v) for v in set(values)), default=(0, None))


@pytest.mark.parametrize("tracked, proposed, whole", [(8192, 32, 0), (16, 2, 0), (32, 32, 0), (8192, 32, 5_000_000)])
def test_most_common_values_of_all_types(spark, monkeypatch, tracked, proposed, whole):
    """Frequent values, flat columns, ties, and sketches too small to tell."""
    monkeypatch.setattr(stats, "COUNTED_WHOLE", whole)
    monkeypatch.setattr(stats, "ITEMS_TRACKED", tracked)
    monkeypatch.setattr(stats, "ITEMS_PROPOSED", proposed)
    df = spark.range(3000).repartition(6).selectExpr(
        "id as flat", "id % 50 as tied", "if(id % 3 = 0, 7, id) as hot", "cast(id % 4 as double) - 2.5 as d",
        "if(id % 5 = 0, double('nan'), -0.0) as zero", "cast(id % 7 as string) as s", "cast(null as string) as none",
        "id % 2 = 0 as b", "date'2024-01-01' + cast(id % 3 as int) as day", "cast(id % 9 as decimal(12,2)) as dec",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id % 5 as int)) as ntz",
        "if(id % 2 = 0, concat('long', id), 'x') as half",
    )
    rows = df.collect()
    found = stats.top_values(df, df.columns)
    assert list(found) == df.columns
    for c in df.columns:
        if c == "zero":
            assert found[c][1] == 2400 and float(found[c][0]) == 0.0
            continue
        minus, v = _most_common(rows, c)
        text = None if v is None else spark.createDataFrame([(v,)], df.select(c).schema).select(
            F.col(c).cast("string")).first()[0]
        assert found[c] == (text, -minus), c


def test_most_common_values_over_many_tasks_without_rows(spark, monkeypatch):
    monkeypatch.setattr(stats, "COUNTED_WHOLE", 0)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "60"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(20).repartition(40, "id").selectExpr("if(id % 4 = 0, null, 5) as x", "cast(null as string) as s")
        assert stats.top_values(df, ["x", "s"]) == {"x": ("5", 15), "s": (None, 0)}
        assert stats.top_values(df.where("x > 9"), ["x", "s"]) == {"x": (None, 0), "s": (None, 0)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_most_common_values_in_few_jobs(spark, monkeypatch):
    monkeypatch.setattr(stats, "COUNTED_WHOLE", 0)
    df = spark.range(500).selectExpr(*[f"id % {k + 2} as c{k}" for k in range(60)])
    tracker = spark.sparkContext.statusTracker()
    # four queries, the first of them a count, each in at most three jobs of adaptive execution
    for columns in (df.columns[:3], df.columns):
        spark.sparkContext.setJobGroup(f"top{len(columns)}", "")
        stats.top_values(df, columns)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("top3")) <= 11 and len(tracker.getJobIdsForGroup("top60")) <= 11


def _arrive(spark, folder, rows):
    spark.createDataFrame(rows, "k bigint, at timestamp_ntz, v string").coalesce(1).write.mode("append").parquet(folder)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Three runs from one checkpoint: what came before is neither lost nor added twice."""
    source, sink, point = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    _arrive(spark, source, [(1, hour(0), "a"), (2, hour(1), "b"), (1, hour(0), "a")])

    def run():
        stream = streaming.file_stream(spark, source)
        out = streaming.run_available(streaming.drop_repeats(stream, ["k"], "at", "2 hours"), sink, point)
        return sorted(tuple(r) for r in out.select("k", "v").collect())

    assert run() == [(1, "a"), (2, "b")] == run()
    _arrive(spark, source, [(2, hour(1), "b"), (3, hour(2), "c"), (3, hour(2), "c")])
    assert run() == [(1, "a"), (2, "b"), (3, "c")] == run()


def test_windows_go_out_once_closed(spark, tmp_path):
    source, sink, point = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)

    def run(keep="first"):
        stream = streaming.file_stream(spark, source)
        picked = streaming.one_per_window(stream, ["v"], "at", "1 hour", "10 minutes", keep, ["k"])
        assert picked.columns == ["k", "at", "v"]
        out = streaming.run_available(picked, f"{sink}-{keep}", f"{point}-{keep}")
        return sorted((r["k"], r["v"]) for r in out.collect())

    _arrive(spark, source, [(3, at(0, 5), "a"), (2, at(0, 5), "a"), (9, at(0, 50), "a"), (4, at(0, 7), "b"), (5, at(1, 5), "a")])
    assert run() == [] and run("last") == []
    _arrive(spark, source, [(6, at(1, 15), "a"), (1, at(0, 1), "a")])  # the late row still meets its window
    assert run() == [(1, "a"), (4, "b")] and run("last") == [(4, "b"), (9, "a")]
    _arrive(spark, source, [(0, at(0, 0), "a"), (7, at(5), "z")])  # too late; all but the last window close
    assert run() == [(1, "a"), (4, "b"), (5, "a")] and run("last") == [(4, "b"), (6, "a"), (9, "a")]
    with pytest.raises(ValueError, match="times"):
        streaming.drop_repeats(streaming.file_stream(spark, source), ["k"], "v", "1 hour")
    with pytest.raises(ValueError, match="keep"):
        run("none")


def test_windows_of_times_without_zone_do_not_depend_on_the_session(spark, tmp_path):
    _arrive(spark, str(tmp_path / "in"), [(1, dt.datetime(2024, 1, 1, 23), "a"), (2, dt.datetime(2024, 1, 2, 1), "a"),
                                          (3, dt.datetime(2024, 1, 9), "z")])
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for k, name in enumerate(("UTC", "America/New_York", "Asia/Tokyo")):
            spark.conf.set("spark.sql.session.timeZone", name)
            stream = streaming.file_stream(spark, str(tmp_path / "in"))
            picked = streaming.one_per_window(stream, ["v"], "at", "1 day", "1 hour")
            out = streaming.run_available(picked, str(tmp_path / f"out{k}"), str(tmp_path / f"point{k}"))
            assert sorted(r["k"] for r in out.collect()) == [1, 2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_lineage_is_cut_in_columns(spark):
    df = spark.range(100).selectExpr("id", "id * 2 as x", "cast(id as string) as s")
    plan = cut_lineage(df).where("x > 10").select("x")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<x:bigint>" in plan and "PushedFilters: [IsNotNull(x), GreaterThan(x,10)]" in plan
    odd = df.selectExpr("id", "null as nothing", "x as ID2")
    assert cut_lineage(odd).count() == 100 and cut_lineage(odd).columns == odd.columns
    twins = spark.range(3).toDF("a").selectExpr("a", "a as A")
    assert cut_lineage(twins).columns == ["a", "A"]
    assert cut_lineage(df.limit(0)).columns == df.columns


@pytest.mark.parametrize("seed", range(3))
def test_correlation_of_many_columns_agrees_with_pairs(spark, monkeypatch, seed):
    """Gaps, constants, values far from nought, columns flat but for one row, and columns that never meet."""
    rng = np.random.default_rng(seed)
    n, p = 200, 24
    x = rng.normal(size=(n, p)) + rng.normal(size=(n, 1))
    x[:, 0] = 5.0
    x[:, 1] = 1e9 + rng.normal(size=n)
    x[:, 2] = 7.0
    x[3, 2] = 7.0 + 1e-3
    x[:, 3] = x[:, 4] * -2 + 1
    gaps = rng.random(size=(n, p)) < 0.2
    gaps[:, 5] = np.arange(n) < 100
    gaps[:, 6] = np.arange(n) >= 100
    gaps[:, 7] = True
    gaps[1:, 8] = True
    rows = [[None if g else float(v) for v, g in zip(r, gs)] for r, gs in zip(x, gaps)]
    df = spark.createDataFrame(rows, ", ".join(f"`c {i}` double" for i in range(p))).repartition(5)

    def found():
        return {(r["index"], r["variable"]): r["value"] for r in profile.correlation_matrix(df).collect()}

    many = found()
    monkeypatch.setattr(profile, "PAIRS_PER_SCAN", 10_000)
    pairs = found()
    assert many.keys() == pairs.keys()
    for k, r in pairs.items():
        assert (many[k] is None) == (r is None), k
        assert r is None or many[k] == pytest.approx(r, abs=1e-6), k


def test_codes_of_categories(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("b", 4), ("", 5), ("é", 6)], "s string, i int").repartition(4)
    coded = ops.encode_categories(df, "s")
    assert coded.columns == ["s", "i", "s_code"]
    assert sorted((r["i"], r["s_code"]) for r in coded.collect()) == [(1, 2), (2, -1), (3, 1), (4, 2), (5, 0), (6, 3)]
    assert ops.encode_categories(df, "s", "s").columns == ["s", "i"]
    assert ops.encode_categories(df.limit(0), "s").count() == 0
    many = spark.range(5000).selectExpr("(id * 7919) % 1013 - 500.5 as x").repartition(7)
    codes = {r["category"]: r["code"] for r in ops.category_codes(many, "x").collect()}
    assert codes == {v: k for k, v in enumerate(sorted(codes))} and len(codes) == 1013
    with pytest.raises(ValueError, match="already"):
        ops.encode_categories(df, "s", "i")
    with pytest.raises(ValueError, match="nested"):
        ops.category_codes(df.selectExpr("array(s) as s"), "s")
