import random

import pytest

from scrubline.operators import drop_rows_with_nulls, fill_nulls, fill_nulls_batch, missing


@pytest.mark.parametrize(
    "method, given, want",
    [
        ("mean", [1.0, None, 3.0, None, 5.0], [1, 3, 3, 3, 5]),
        ("median", [1.0, None, 3.0, None, 10.0], [1, 3, 3, 3, 10]),
        ("zero", [1.0, None, 3.0, None, 5.0], [1, 0, 3, 0, 5]),
        ("ffill", [1.0, None, None, 4.0, None], [1, 1, 1, 4, 4]),
        ("bfill", [None, 2.0, None, 4.0, None], [2, 2, 4, 4, None]),
        ("mean", [float("nan"), 2.0, 4.0], [3, 2, 4]),
    ],
)
def test_fill(table, values, method, given, want):
    assert values(fill_nulls(table("x double", given), "x", method), "x") == want


def test_mode_takes_the_lowest_of_ties(table, values):
    df = table("s string", ["b", None, "a", "a", "b"])
    assert values(fill_nulls(df, "s", "mode"), "s") == ["b", "a", "a", "a", "b"]


def test_mode_of_nothing_changes_nothing(table, values):
    assert values(fill_nulls(table("s string", [None, None]), "s", "mode"), "s") == [None, None]


def test_mode_of_times_and_dates(table, values):
    df = table("s string", ["2024-01-02", None, "2024-01-02", "2024-01-01"]).selectExpr(
        "cast(s as timestamp_ntz) as t", "_row_id"
    )
    assert [str(v) for v in values(fill_nulls(df, "t", "mode"), "t")][1] == "2024-01-02 00:00:00"


def test_zero_into_text(table, values):
    assert values(fill_nulls(table("s string", ["a", None]), "s", "zero"), "s") == ["a", "0"]


def test_custom(table, values):
    df = table("s string, n bigint", [("a", 1), (None, None)])
    assert values(fill_nulls(df, "s", "custom", "z"), "s") == ["a", "z"]
    assert values(fill_nulls(df, "n", "custom", 7), "n") == [1, 7]
    assert values(fill_nulls(df, "n", "custom", 0.5), "n") == [1.0, 0.5]


def test_custom_refusals(table):
    df = table("s string, n bigint", [("a", 1), (None, None)])
    with pytest.raises(ValueError):
        fill_nulls(df, "n", "custom")
    with pytest.raises(TypeError):
        fill_nulls(df, "n", "custom", "text")
    with pytest.raises(ValueError):
        fill_nulls(df, "n", "backwards")
    with pytest.raises(ValueError, match="convert to numeric"):
        fill_nulls(df, "s", "mean")


def test_whole_numbers_keep_their_type_where_the_fill_fits(table):
    df = table("n bigint", [1, None])
    assert fill_nulls(df, "n", "zero").schema["n"].dataType.simpleString() == "bigint"
    assert fill_nulls(df, "n", "mean").schema["n"].dataType.simpleString() == "double"


def test_batch_skips_what_it_cannot_fill(table, values):
    df = table("n double, s string", [(1.0, None), (None, "a")])
    filled = fill_nulls_batch(df, ["n", "s", "nope"], "median")
    assert values(filled, "n") == [1.0, 1.0]
    assert values(filled, "s") == [None, "a"]
    assert values(fill_nulls_batch(df, ["n"], "no such method"), "n") == [1.0, None]


def test_drop_rows_counts_nan_as_missing(table, values):
    df = table("x double", [1.0, None, float("nan"), 2.0])
    assert values(drop_rows_with_nulls(df, "x"), "x") == [1.0, 2.0]


def test_row_order_is_never_guessed(table):
    df = table("x double", [1.0, None], row_id=False)
    with pytest.raises(ValueError, match="order"):
        fill_nulls(df, "x", "ffill")


@pytest.mark.parametrize("gap", [0.3, 0.97])
@pytest.mark.parametrize("method", ["ffill", "bfill"])
def test_ranges_join_seamlessly(table, values, monkeypatch, method, gap):
    """Many small ranges, whole ranges without a value, two columns at once."""
    monkeypatch.setattr(missing, "ROWS_PER_RANGE", 40)
    rng = random.Random(7)
    rows = [
        tuple(None if rng.random() < gap else rng.random() for _ in range(2)) for _ in range(1500)
    ]
    rows[500:800] = [(None, None)] * 300
    df = table("a double, b double", rows).repartition(5)
    filled = fill_nulls_batch(df, ["a", "b"], method)
    for i, name in enumerate("ab"):
        want = [r[i] for r in rows]
        span = range(len(want)) if method == "ffill" else range(len(want) - 1, -1, -1)
        last = None
        for j in span:
            last = want[j] if want[j] is not None else last
            want[j] = last
        assert values(filled, name) == want


def test_ranges_of_text(table, values, monkeypatch):
    monkeypatch.setattr(missing, "ROWS_PER_RANGE", 20)
    df = table("s string", [f"t{i}" if i % 37 == 5 else None for i in range(300)])
    want = [None] * 5 + [f"t{i // 37 * 37 + 5 if i % 37 >= 5 else i // 37 * 37 - 32}" for i in range(5, 300)]
    assert values(fill_nulls(df, "s", "ffill"), "s") == want


def test_fill_along_a_time_column(table, monkeypatch):
    monkeypatch.setattr(missing, "ROWS_PER_RANGE", 10)
    df = table("x double", [float(i) if i % 3 == 0 else None for i in range(100)]).selectExpr(
        "x", "timestamp_ntz'2024-03-10 00:00:00' + make_dt_interval(0, 0, _row_id) as at"
    )
    filled = fill_nulls(df, "x", "ffill", order_by="at")
    assert [r[0] for r in filled.orderBy("at").select("x").collect()] == [
        float(i // 3 * 3) for i in range(100)
    ]


@pytest.mark.parametrize("method", ["ffill", "bfill"])
def test_null_keys_in_one_range_and_many(spark, monkeypatch, method):
    """Rows without an order key come first, however the rows are cut."""
    rows = [(None, 7.0), (None, None)] + [(i, float(i) if i % 9 == 4 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "k bigint, x double").repartition(4)
    one = sorted(map(str, fill_nulls(df, "x", method, order_by="k").where("k is not null").collect()))
    monkeypatch.setattr(missing, "ROWS_PER_RANGE", 20)
    many = sorted(map(str, fill_nulls(df, "x", method, order_by="k").where("k is not null").collect()))
    assert one == many


def test_values_that_do_not_fit(table):
    df = table("n int, d date, b boolean", [(1, None, None), (None, None, True)])
    for column, fill in (("n", 3_000_000_000), ("d", "abc"), ("b", "perhaps")):
        with pytest.raises(ValueError):
            fill_nulls(df, column, "custom", fill)
    with pytest.raises(ValueError):
        fill_nulls(df, "d", "zero")
    assert fill_nulls(df, "d", "custom", "2024-01-02").where("d = '2024-01-02'").count() == 2


def _along(rows, method, key, group):
    """Filled x of rows (id, ...), by a plain loop."""
    ordered = sorted(rows, key=key, reverse=method == "bfill")
    known, out = {}, {}
    for r in ordered:
        if r["x"] is not None:
            known[group(r)] = r["x"]
        out[r["id"]] = known.get(group(r))
    return out


@pytest.mark.parametrize("method", ["ffill", "bfill"])
@pytest.mark.parametrize("rows_per_range", [7, 100, 10_000])
def test_groups_ties_and_two_order_columns(spark, method, rows_per_range):
    """One group holds most rows and spans many ranges; order keys tie and are missing."""
    rng = random.Random(rows_per_range)
    rows = [
        {
            "id": i, "g": rng.choice(["hot"] * 6 + ["a", "b", None]), "day": rng.choice([None, 1, 1, 2, 3]),
            "hour": rng.choice([None, 0.5, 1.5]), "x": rng.choice([None, None, None, float(i)]),
        }
        for i in range(400)
    ]
    df = spark.createDataFrame(
        [tuple(r.values()) for r in rows], "id bigint, g string, day int, hour double, x double"
    ).repartition(5)
    low = lambda v: (v is not None, v if v is not None else 0)
    for within in ([], ["g"]):
        # ties go by the table's other columns, left to right: here by id
        key = lambda r, w=within: (*[low(r[c]) if c != "g" else (r[c] is not None, r[c] or "") for c in w],
                                   low(r["day"]), low(r["hour"]), r["id"])
        filled = fill_nulls_batch(
            df, ["x"], method, order_by=["day", "hour"], rows_per_range=rows_per_range, within=within
        )
        assert filled.columns == df.columns
        want = _along(rows, method, key, lambda r, w=within: r["g"] if w else 0)
        assert {r["id"]: r["x"] for r in filled.collect()} == want


def test_text_order_and_nested_columns(spark):
    df = spark.createDataFrame([("b", None, [1]), ("a", 1.0, [2]), ("c", None, None)], "k string, x double, n array<int>")
    for rows_per_range in (1, 100):
        filled = fill_nulls_batch(df, ["x", "n"], "ffill", order_by="k", rows_per_range=rows_per_range)
        assert {r["k"]: (r["x"], r["n"]) for r in filled.collect()} == {"a": (1.0, [2]), "b": (1.0, [1]), "c": (1.0, [1])}
    with pytest.raises(ValueError, match="nested"):
        fill_nulls(df, "x", "ffill", order_by="n")


def test_ranges_have_a_bound(table, values, monkeypatch):
    monkeypatch.setattr(missing, "MAX_RANGES", 3)
    df = table("x double", [float(i) if i % 50 == 0 else None for i in range(500)])
    filled = fill_nulls_batch(df, ["x"], "ffill", rows_per_range=2)
    assert values(filled, "x") == [float(i // 50 * 50) for i in range(500)]


def test_an_empty_table_along_order(table):
    assert fill_nulls_batch(table("x double", []), ["x"], "ffill", rows_per_range=1).count() == 0


@pytest.mark.parametrize("method", ["ffill", "bfill"])
@pytest.mark.parametrize("least", [1, 3, 64])
def test_ranges_are_more_than_partitions(spark, monkeypatch, method, least):
    """Spark samples rows of every range partition for the driver, so small ranges do not make more of these."""
    monkeypatch.setattr(missing, "LEAST_PARTITIONS", least)
    sorted_into = []
    cut = missing.cut_lineage
    monkeypatch.setattr(missing, "cut_lineage", lambda df, name: sorted_into.append(df.rdd.getNumPartitions()) or cut(df, name))
    rng = random.Random(least)
    rows = [{"id": i, "g": rng.choice("aaab"), "x": rng.choice([None, None, None, None, float(i)])} for i in range(900)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id bigint, g string, x double").repartition(4)
    for within in ([], ["g"]):
        filled = fill_nulls_batch(df, ["x"], method, order_by="id", rows_per_range=4, within=within)
        want = _along(rows, method, lambda r, w=within: (r["g"] if w else "", r["id"]), lambda r, w=within: r["g"] if w else 0)
        assert {r["id"]: r["x"] for r in filled.collect()} == want
    assert max(sorted_into) <= least
