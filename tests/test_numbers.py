import math
import random

import numpy as np
import pandas as pd
import pytest

from scrubline import operators as ops
from scrubline.functions import numbers, stats


@pytest.mark.parametrize(
    "method, decimals, given",
    [
        ("round", 2, [1.234, 5.678, 9.999, 2.675, 1.005, -2.5, None]),
        ("round", 0, [0.5, 1.5, 2.5, -0.5]),
        ("round", -1, [15.0, 25.0, 34.9]),
        ("ceil", 0, [1.234, 5.678, 9.001]),
        ("floor", 0, [1.789, 5.999, 9.001, -1.5]),
        ("floor", 1, [1e300, math.inf, -math.inf, 1.25]),
    ],
)
def test_rounding_like_numpy(table, values, method, decimals, given):
    series = pd.Series(given, dtype="float64")
    if method == "round":
        want = series.round(decimals)
    else:
        want = getattr(np, method)(series * 10.0**decimals) / 10.0**decimals
    got = values(ops.round_numeric(table("x double", given), "x", decimals, method), "x")
    pd.testing.assert_series_equal(pd.Series(got, dtype="float64"), want)


def test_rounding_whole_numbers_keeps_them(table, values):
    df = table("n bigint", [14, 15, 25, None])
    out = ops.round_numeric(df, "n", -1)
    assert values(out, "n") == [10, 20, 20, None]
    assert out.schema["n"].dataType.simpleString() == "bigint"


def test_clip(table, values):
    df = table("x double", [-5.0, -2.0, 0.0, 3.0, None])
    assert values(ops.clip_numeric(df, "x", lower=0), "x") == [0, 0, 0, 3, None]
    assert values(ops.clip_numeric(df, "x", upper=-2.0), "x") == [-5, -2, -2, -2, None]
    assert values(ops.clip_numeric(df, "x"), "x") == [-5, -2, 0, 3, None]


def test_scaling(table, values):
    assert values(ops.scale_numeric(table("x double", [0.0, 50.0, 100.0]), "x", "minmax"), "x") == [0, 0.5, 1]
    scores = values(ops.scale_numeric(table("x bigint", [10, 20, 30, 40, 50]), "x", "zscore"), "x")
    assert scores == pytest.approx([(v - 30) / np.std([10, 20, 30, 40, 50], ddof=1) for v in (10, 20, 30, 40, 50)])
    same = table("x double", [5.0, 5.0])
    assert values(ops.scale_numeric(same, "x", "minmax"), "x") == [5, 5]
    assert values(ops.scale_numeric(same, "x", "zscore"), "x") == [5, 5]
    assert values(ops.scale_numeric(table("x double", [5.0]), "x", "zscore"), "x") == [None]
    with pytest.raises(ValueError):
        ops.scale_numeric(same, "x", "robust")


def test_math(table, values):
    df = table("x double", [4.0, 0.0, -1.0, None])
    assert values(ops.apply_math(df, "x", "sqrt"), "x") == [2, 0, None, None]
    assert values(ops.apply_math(df, "x", "log"), "x") == [math.log(4), -math.inf, None, None]
    assert values(ops.apply_math(df, "x", "abs"), "x") == [4, 0, 1, None]
    assert values(ops.apply_math(df, "x", "square"), "x") == [16, 0, 1, None]
    assert values(ops.apply_math(table("n int", [100_000]), "n", "square"), "n") == [10**10]


def _cut_cases():
    rng = random.Random(11)
    cases = [([1, 25, 50, 75, 99], 4), ([5, 5, 5], 2), ([0, 0], 3), ([0.0001, 0.0002, 0.0003], 3),
             ([-3, -3.0005], 4), ([1e-9, 1], 5), ([1e6, 3e7], 7), ([1, 2, 3, 4, 100], 1)]
    for _ in range(40):
        scale = 10 ** rng.randint(-5, 6)
        cases.append(([rng.uniform(-1, 1) * scale for _ in range(30)], rng.randint(1, 25)))
    return cases


@pytest.mark.parametrize("given, bins", _cut_cases())
def test_labels_like_pandas(given, bins):
    edges = numbers.bin_edges(float(min(given)), float(max(given)), bins)
    want = [str(c) for c in pd.cut(pd.Series(given), bins).cat.categories]
    assert numbers.bin_labels(edges) == want


def test_bins_like_pandas(table, values):
    rng = random.Random(5)
    given = [rng.gauss(0, 10) for _ in range(400)] + [0.0, 10.0, 20.0, 30.0]
    for bins in (1, 3, 10, 40):
        out = values(ops.bin_numeric(table("x double", given), "x", bins, new_column="b"), "b")
        assert out == [str(v) for v in pd.cut(pd.Series(given), bins)]
    whole = [float(i) for i in range(101)]
    out = values(ops.bin_numeric(table("x double", whole), "x", 10), "x")
    assert out == [str(v) for v in pd.cut(pd.Series(whole), 10)]


def test_bins_of_missing_values(table, values):
    df = table("x double", [1.0, None, 9.0])
    out = values(ops.bin_numeric(df, "x", 2, labels=["low", "high"]), "x")
    assert out == ["low", None, "high"]
    assert values(ops.bin_numeric(table("x double", [None, None]), "x", 2), "x") == [None, None]


SPIKE = [10.0, 11.0, 12.0, 13.0, 14.0, 15.0, 16.0, 17.0, 18.0, 1000.0]


def test_outlier_actions(table, values):
    df = table("x double", [*SPIKE, None])

    def last(action, value=None, method="iqr"):
        return values(ops.remove_outliers(df, "x", method, action, value), "x")

    assert last("null")[9] is None
    assert 1000.0 not in last("drop") and None in last("drop")
    q1, q3 = np.percentile(SPIKE, [25, 75])
    assert last("clip")[9] == q3 + 1.5 * (q3 - q1)
    assert last("replace", 0)[9] == 0
    assert last("mean")[9] == 14.0
    assert last("median")[9] == 14.0
    assert last("replace", "MEAN")[9] == 14.0
    with pytest.raises(ValueError):
        last("replace")
    with pytest.raises(TypeError):
        last("replace", "big")
    with pytest.raises(ValueError):
        last("hide")
    with pytest.raises(ValueError):
        last("null", method="mad")


def test_zscore_outliers(table, values):
    given = [float(i % 5) for i in range(40)] + [100.0]
    df = table("x double", given)
    assert values(ops.remove_outliers(df, "x", "zscore"), "x")[-1] is None
    mean, std = np.mean(given), np.std(given, ddof=1)
    assert values(ops.remove_outliers(df, "x", "zscore", "clip"), "x")[-1] == pytest.approx(mean + 3 * std)
    same = table("x double", [2.0, 2.0])
    assert values(ops.remove_outliers(same, "x", "zscore", "drop"), "x") == [2, 2]


def test_worked_outliers(table, values):
    df = table("x double", [1.123, 50.0, 1000.0, -5.5, 10.0, 20.0, 30.0])
    assert values(ops.remove_outliers(df, "x"), "x")[2] is None
    df = table("x double", [1000.0, 10.0, 20.0, 30.0])
    assert values(ops.remove_outliers(df, "x", action="mean"), "x")[0] == 20.0


def test_negatives(table, values):
    df = table("n bigint", [10, -5, 20, -1, 30])
    assert values(ops.replace_negative_values(df, "n"), "n") == [10, 0, 20, 0, 30]
    assert values(ops.replace_negative_values(df, "n", "Mean"), "n") == [10, 20, 20, 20, 30]
    assert values(ops.replace_negative_values(df, "n", "median"), "n") == [10, 20, 20, 20, 30]
    assert values(ops.replace_negative_values(df, "n", "1.5"), "n") == [10, 1.5, 20, 1.5, 30]
    with pytest.raises(TypeError):
        ops.replace_negative_values(df, "n", "text")
    all_negative = table("x double", [-1.0, -2.0])
    assert values(ops.replace_negative_values(all_negative, "x", "mean"), "x") == [0, 0]


def test_text_is_not_numeric(table):
    df = table("s string", ["1", "2"])
    for call in (lambda: ops.clip_numeric(df, "s", 0), lambda: ops.remove_outliers(df, "s")):
        with pytest.raises(ValueError, match="convert to numeric first"):
            call()


PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("limit, held", [(1, 1), (50, 60), (50, 5000), (10_000_000, 1)])
def test_quantiles_are_exact_at_any_limit(table, limit, held):
    """The narrowing search, forced by a low limit, finds numpy's answer."""
    rng = random.Random(2)
    n = 3000
    shapes = {
        "even": [rng.random() for _ in range(n)],
        "tied": [float(rng.randint(0, 3)) for _ in range(n)],
        # one value holds over a third of all rows, with a long tail beside it
        "hot": [7.0 if rng.random() < 0.4 else rng.lognormvariate(0, 6) for _ in range(n)],
        "flat": [1.0] * n,
        "gaps": [None if rng.random() < 0.5 else rng.gauss(0, 1) for _ in range(n)],
    }
    df = table(", ".join(f"{k} double" for k in shapes), list(zip(*shapes.values()))).repartition(4)
    found = stats.exact_quantiles(df, dict.fromkeys(shapes, PROBABILITIES), percentile_rows=limit, sorted_rows=held)
    for name, given in shapes.items():
        kept = [v for v in given if v is not None]
        want = np.percentile(kept, [100 * p for p in PROBABILITIES])
        assert [found[name][p] for p in PROBABILITIES] == pytest.approx(list(want), rel=1e-12), name


def test_quantiles_of_nothing(table):
    df = table("x double", [None, None])
    assert stats.exact_quantiles(df, {"x": [0.5]}) == {"x": {0.5: None}}


def test_range_splits_are_even_in_two_levels(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 60_000, 1, 6).select((F.col("id") * F.col("id")).alias("k"))
    splits = stats.range_splits(df, F.col("k"), 600)
    assert len(splits) > 400
    sizes = [r["count"] for r in stats.bucket_of(df, "k", splits, "b").groupBy("b").count().collect()]
    assert max(sizes) < 5 * 60_000 / 600


def test_infinite_values_are_refused_by_bins(table):
    df = table("x double", [1.0, 2.0, float("inf")])
    with pytest.raises(ValueError, match="finite"):
        ops.bin_numeric(df, "x", 4)


def test_whole_numbers_that_overflow_are_null(table, values):
    df = table("n bigint", [4_000_000_000, -3, -(2**63)])
    assert values(ops.apply_math(df, "n", "square"), "n") == [None, 9, None]
    assert values(ops.apply_math(df, "n", "abs"), "n") == [4_000_000_000, 3, None]
