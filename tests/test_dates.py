import datetime as dt
import warnings

import pandas as pd
import pytest

from scrubline import operators as ops
from scrubline.functions import dates
from scrubline.frames import named


def parsed(series_values, **how):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = pd.to_datetime(pd.Series(series_values, dtype="object"), errors="coerce", **how)
    return [None if pd.isna(v) else v.to_pydatetime() for v in got]


LISTS = [
    ["01-02-2024", "13-02-2024", "2024-01-01", "02/03/2024"],
    ["13-02-2024", "01-02-2024", "31-12-2023", "2024-01-01"],
    ["2024-01-05", "2024-02-30", "2024-1-5", None, "x"],
    ["2024/01/05", "2024/12/31", "2024-01-05"],
    ["20240105", "20241231", "2024"],
    ["01/02/2024", "12/31/2024", "31/12/2024"],
    ["2024-01-05 10:20:30", "2024-01-05", "2024-01-05 23:59:59"],
    ["2024-01-05T10:20:30", "2024-01-06T00:00:00"],
    ["2024-01-05 10:20", "2024-01-06 11:30"],
    ["2024-01-05 10:20:30.123456", "2024-01-06 00:00:00.5"],
    ["05 Jan 2024", "17 feb 2023", "2024-01-01"],
    ["05-Mar-2024", "17-DEC-2023"],
    ["January 5, 2024", "March 17, 2023"],
    ["1/2/2024", "11/12/2024", "13/1/2024"],
    ["not_a_date", "2024-01-05", "01/02/2024", "13/02/2024", "20240107"],
    [None, None],
]


@pytest.mark.parametrize("given", LISTS)
def test_format_of_the_first_value_like_pandas(table, values, given):
    out = ops.convert_to_datetime(table("s string", given), "s")
    assert values(out, "s") == parsed(given)


FORMATS = ["%Y-%m-%d", "%d-%m-%Y", "%m/%d/%Y", "%Y/%m/%d", "%d.%m.%y", "%Y%m%d", "%H:%M:%S %d/%m/%Y",
           "%d %b %Y", "%B %d, %Y", "%Y-%m-%d %I:%M %p"]
TEXTS = ["2024-01-05", "05-01-2024", "01/05/2024", "2024/01/05", "5.1.24", "05.01.71", "20240105", "x", "",
         "10:11:12 5/1/2024", "05 Jan 2024", "5 jan 2024", "January 05, 2024", "2024-01-05 01:30 PM",
         "2024-13-01", "2023-02-29", "2024-01-05 ", "99-99-9999"]


@pytest.mark.parametrize("fmt", FORMATS)
def test_given_format_like_pandas(table, values, fmt):
    out = ops.convert_to_datetime(table("s string", TEXTS), "s", fmt)
    assert values(out, "s") == parsed(TEXTS, format=fmt)


def test_unknown_directives_are_refused(table):
    with pytest.raises(ValueError):
        ops.convert_to_datetime(table("s string", ["x"]), "s", "%Q")


def test_format_needs_row_order(table):
    with pytest.raises(ValueError, match="order"):
        ops.convert_to_datetime(table("s string", ["2024-01-01"], row_id=False), "s")


def test_parsing_ignores_the_session_time_zone(spark, table, values):
    """02:30 does not exist in New York on that day."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = table("s string", ["2024-03-10 02:30:00"])
        assert values(ops.convert_to_datetime(df, "s"), "s") == [dt.datetime(2024, 3, 10, 2, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


MOMENTS = ["2023-01-02 00:00:00", "2023-01-08 13:14:15", "2024-02-29 23:59:59", "2023-12-31 00:00:00"]


@pytest.fixture
def moments(table):
    return table("s string", [*MOMENTS, None]).selectExpr("cast(s as timestamp_ntz) as t", "_row_id")


@pytest.mark.parametrize("part", ["year", "month", "day", "weekday", "quarter"])
def test_parts_like_pandas(moments, values, part):
    want = getattr(pd.to_datetime(pd.Series(MOMENTS)).dt, "day_name" if part == "weekday" else part)
    want = list(want() if callable(want) else want)
    assert values(ops.extract_date_part(moments, "t", part, "p"), "p") == [*want, None]


def test_part_in_place_of_text(table, values):
    df = table("s string", ["2023-01-02", "bad"])
    assert values(ops.extract_date_part(df, "s", "weekday"), "s") == ["Monday", None]
    with pytest.raises(ValueError):
        ops.extract_date_part(df, "s", "hour")


@pytest.mark.parametrize("unit", ["days", "weeks", "months", "years"])
@pytest.mark.parametrize("n", [7, -13, 0])
def test_offsets_like_pandas(moments, values, unit, n):
    want = [(pd.Timestamp(m) + pd.DateOffset(**{unit: n})).to_pydatetime() for m in MOMENTS]
    assert values(ops.offset_date(moments, "t", n, unit, "o"), "o") == [*want, None]


def test_offset_converts_the_source_too(table, values):
    df = table("s string", ["2023-01-01", "2023-01-15"])
    out = ops.offset_date(df, "s", 7, "days", "later")
    assert values(out, "later") == [dt.datetime(2023, 1, 8), dt.datetime(2023, 1, 22)]
    assert values(out, "s") == [dt.datetime(2023, 1, 1), dt.datetime(2023, 1, 15)]


@pytest.mark.parametrize("reference", ["2023-06-01", "2020-01-01 06:30:00"])
@pytest.mark.parametrize("unit", ["days", "weeks", "hours", "years"])
def test_differences_like_pandas(moments, values, reference, unit):
    gaps = [pd.Timestamp(reference) - pd.Timestamp(m) for m in MOMENTS]
    want = {
        "days": [g.days for g in gaps],
        "weeks": [g.days / 7 for g in gaps],
        "hours": [g.total_seconds() / 3600 for g in gaps],
        "years": [g.days / 365.25 for g in gaps],
    }[unit]
    got = values(ops.date_difference(moments, "t", reference, unit, "g"), "g")
    assert got == pytest.approx([*want, None])


def test_difference_to_today(table, values):
    df = table("s string", [dt.date.today().isoformat()])
    assert values(ops.date_difference(df, "s"), "s") == [0]


def test_epoch_round_trip(moments):
    back = dates.from_epoch_micros(dates.epoch_micros(named("t")))
    assert moments.where(~back.eqNullSafe(named("t"))).count() == 0


@pytest.mark.parametrize(
    "text,want",
    [
        ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"),
        ("2024-01-02T03:04:05+02:00", "2024-01-02 01:04:05"),
        ("2024-01-02 03:04:05.25-0130", "2024-01-02 04:34:05.25"),
        ("2024-01-02T03:04:05.123456789", "2024-01-02 03:04:05.123456"),
        ("2024-01", "2024-01-01 00:00:00"),
    ],
)
def test_iso_time_stamps(table, text, want):
    for first in (text, "no date"):  # the first value's format, or each on its own
        out = ops.convert_to_datetime(table("t string", [first, text]), "t")
        got = out.where("_row_id = 1").selectExpr("CAST(t AS STRING)").first()[0]
        assert got == want
