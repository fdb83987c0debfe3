import datetime as dt

import pandas as pd
import pytest

from scrubline import operators as ops
from scrubline.operators import rows, types

NUMBERS = ["123", " 4.5 ", "abc", "1e3", "1d", "1f", "nan", "inf", "-Infinity", "1_000", "1,000", "0x10",
           "True", "$5", "", ".5", "5.", "+7", None]


def test_numbers_like_pandas(table, values):
    out = values(ops.convert_column_type(table("s string", NUMBERS), "s", "numeric"), "s")
    want = pd.to_numeric(pd.Series(NUMBERS, dtype="object"), errors="coerce")
    pd.testing.assert_series_equal(pd.Series(out, dtype="float64"), want.astype("float64"))


def test_booleans(table, values):
    given = ["yes", "NO", " True ", "bad", "1.0", "0", "t", "N", None, "2"]
    want = [True, False, True, None, True, False, True, False, None, None]
    assert values(ops.convert_column_type(table("s string", given), "s", "boolean"), "s") == want
    assert values(ops.convert_column_type(table("n bigint", [1, 0, 2]), "n", "boolean"), "n") == [True, False, None]
    assert values(ops.convert_column_type(table("x double", [1.0, 0.0]), "x", "boolean"), "x") == [True, False]


def test_strings_keep_missing(table, values):
    assert values(ops.convert_column_type(table("n bigint", [1, None]), "n", "string"), "n") == ["1", None]


def test_categories_are_kept(table):
    df = table("s string", ["b", "a", None, "b"])
    assert not types.is_categorical(df, "s")
    assert types.is_categorical(ops.convert_column_type(df, "s", "categorical"), "s")
    assert [tuple(r) for r in types.category_frame(df, "s").collect()] == [("a", 1), ("b", 2)]


def test_category_lists_stay_out_of_metadata(table):
    out = ops.convert_column_type(table("n bigint", [1, 2, 3]), "n", "categorical")
    assert out.schema["n"].metadata == {"categorical": True} and out.count() == 3


def test_batch_conversion(table, values):
    df = table("a string, b string, c bigint", [("1", "2024-01-01", 3), ("x", "bad", None)])
    assert values(ops.convert_columns_batch(df, ["a", "nope"], "numeric"), "a") == [1.0, None]
    assert values(ops.convert_columns_batch(df, ["b"], "datetime"), "b") == [dt.datetime(2024, 1, 1), None]
    assert values(ops.convert_columns_batch(df, ["c"], "string"), "c") == ["3", None]
    assert ops.convert_columns_batch(df, ["c"], "boolean").schema == df.schema


def test_unknown_target(table):
    with pytest.raises(ValueError):
        ops.convert_column_type(table("a string", ["1"]), "a", "complex")


@pytest.fixture
def abc(table):
    return table("a bigint, b string, `c.d` double", [(1, "x,y", 1.5), (2, " z , ,w,q", None), (3, None, 2.0)])


def test_dropping(abc):
    assert ops.drop_column(abc, "b").columns == ["a", "c.d", "_row_id"]
    assert ops.drop_columns_batch(abc, ["a", "c.d", "nope"]).columns == ["b", "_row_id"]
    with pytest.raises(ValueError):
        ops.drop_column(abc, "nope")


def test_renaming(abc):
    assert ops.rename_column(abc, "c.d", "e").columns == ["a", "b", "e", "_row_id"]
    for old, new in [("nope", "e"), ("a", "b")]:
        with pytest.raises(ValueError):
            ops.rename_column(abc, old, new)


def test_reordering(abc):
    assert ops.reorder_columns(abc, ["c.d", "a"]).columns == ["c.d", "a", "b", "_row_id"]
    with pytest.raises(ValueError):
        ops.reorder_columns(abc, ["nope"])


def test_splitting(abc, values):
    out = ops.split_column(abc, "b", ",", ["p", "q", "r"])
    assert "b" not in out.columns
    assert values(out, "p") == ["x", "z", None]
    assert values(out, "q") == ["y", None, None]
    assert values(out, "r") == [None, "w", None]
    assert "b" in ops.split_column(abc, "b", ",", ["p"], keep_original=True).columns


def test_splitting_is_literal(table, values):
    df = table("s string", ["a.*b.*c", "a\\Eb", None])
    assert values(ops.split_column(df, "s", ".*", ["x", "y"]), "y") == ["b", None, None]
    assert values(ops.split_column(df, "s", "\\E", ["x", "y"]), "y") == [None, "b", None]


def test_merging(abc, values):
    out = ops.merge_columns(abc, ["a", "b", "c.d"], "-", "m", drop_original=False)
    assert values(out, "m") == ["1-x,y-1.5", "2- z , ,w,q", "3-2.0"]
    assert ops.merge_columns(abc, ["a", "b"], "-", "m").columns == ["c.d", "_row_id", "m"]
    with pytest.raises(ValueError):
        ops.merge_columns(abc, ["a", "nope"], "-", "m")


def test_merging_nothing_is_missing(table, values):
    df = table("a string, b string", [(None, None), ("x", None)])
    assert values(ops.merge_columns(df, ["a", "b"], " ", "m"), "m") == [None, "x"]


def test_calculating(spark, table, values):
    df = table("a bigint, b bigint", [(1, 10), (2, 0), (3, None)])
    assert values(ops.create_calculated_column(df, "s", "a + b"), "s") == [11, 2, None]
    assert values(ops.create_calculated_column(df, "q", "a / b"), "q") == [0.1, None, None]
    assert values(ops.create_calculated_column(df, "t", "a % b"), "t") == [1, None, None]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    for name, formula in [("a", "b"), ("z", "nope + 1"), ("z", "a +")]:
        with pytest.raises(ValueError):
            ops.create_calculated_column(df, name, formula)


COPIES = [(1, "a"), (2, "b"), (2, "b"), (3, "c"), (3, "c"), (3, "c"), (4, None), (4, None)]


def kept(df):
    return [r["_row_id"] for r in df.orderBy("_row_id").collect()]


def test_deduplication_of_whole_rows(table):
    df = table("id bigint, v string", COPIES)
    assert kept(ops.deduplicate_rows(df)) == [0, 1, 3, 6]
    assert kept(ops.deduplicate_rows(df, keep="last")) == [0, 2, 5, 7]
    assert kept(ops.deduplicate_rows(df, keep=False)) == [0]
    with pytest.raises(ValueError):
        ops.deduplicate_rows(df, keep="any")


def test_deduplication_on_some_columns(table, values):
    df = table("id bigint, v string", [(1, "a"), (1, "b"), (2, "c"), (2, None)])
    out = ops.deduplicate_rows(df, ["id"])
    assert out.columns == df.columns and values(out, "v") == ["a", "c"]
    assert values(ops.deduplicate_rows(df, ["id"], "last"), "v") == ["b", None]
    assert ops.deduplicate_rows(df, ["id"], False).count() == 0


def test_deduplication_without_row_order(table):
    df = table("id bigint, v string", COPIES, row_id=False)
    assert ops.deduplicate_rows(df).count() == 4
    with pytest.raises(ValueError, match="order"):
        ops.deduplicate_rows(df, ["id"])


def test_nan_and_missing_are_one_value(table):
    df = table("x double", [float("nan"), None, 1.0])
    assert ops.deduplicate_rows(df).count() == 2


def test_duplicate_probe(table):
    df = table("id bigint, v string", COPIES)
    assert rows.duplicate_count(df, ["id"]).first()[0] == 4
    assert rows.duplicate_count(df.where("false"), ["id"]).first()[0] == 0


def test_preview_is_in_row_order(table):
    df = table("x bigint", list(range(100))).repartition(7)
    assert [r["x"] for r in ops.preview_rows(df, 20).collect()] == list(range(20))


def test_copies_with_nan_and_maps(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, double('NaN'), map('a', 1, 'b', 2)), (1, null, map('b', 2, 'a', 1)), "
        "(2, 1.0D, map()) AS t(k, x, m)"
    )
    out = ops.deduplicate_rows(df)
    assert out.dtypes == df.dtypes and sorted(r["k"] for r in out.collect()) == [1, 2]


def test_new_names_that_are_old_ones(table):
    df = table("x string, y string", [("a-b", "c")])
    assert ops.merge_columns(df, ["x", "y"], "-", "x").select("x").first()[0] == "a-b-c"
    assert ops.split_column(df, "x", "-", ["x", "z"]).select("x", "z").first()[:] == ("a", "b")
