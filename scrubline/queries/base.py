"""Registered queries: each an operator run over whole test tables, with the
DuckDB SQL that must give the same rows where SQL can say it.

The test tables are clean, so queries start from dirtied views of them. A view
is a list of expressions that mean the same in Spark SQL and in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class View:
    table: str
    expressions: tuple[str, ...]

    def read(self, spark: SparkSession, folder: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{self.table}.parquet").selectExpr(*self.expressions)

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(self.expressions)} FROM {self.table})"


def view(table: str, *expressions: str) -> View:
    return View(table, expressions)


def query(name: str, source: View, sql: str | None = None):
    """Register ``fn(df)`` over a view; ``{t}`` in the SQL stands for the view."""

    def add(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(source.read(spark, folder))
        if sql is not None:
            ORACLES[name] = sql.replace("{t}", source.sql)
        return fn

    return add


EVENTS = view(
    "events",
    "event_id",
    "ts",
    "user_id",
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type",
)

ORDERS = view(
    "orders",
    "o_orderkey",
    "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS o_custkey",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice",
    "o_orderdate",
    "o_orderpriority",
)

# Names with edge spaces, changed case, blanks and gaps.
CUSTOMERS = view(
    "customer",
    "c_custkey",
    "CASE c_custkey % 6 WHEN 0 THEN '  ' || c_name WHEN 1 THEN lower(c_name) WHEN 2 THEN '' "
    "WHEN 3 THEN upper(c_name) || ' ' WHEN 4 THEN NULL ELSE c_name END AS c_name",
    "CASE c_custkey % 4 WHEN 0 THEN ' ' || c_mktsegment WHEN 1 THEN lower(c_mktsegment) "
    "WHEN 2 THEN '' ELSE c_mktsegment END AS c_mktsegment",
    "c_acctbal",
)

# Dates as text, every fifth of them none.
DATED = view(
    "orders",
    "o_orderkey",
    "CASE WHEN o_orderkey % 5 = 4 THEN 'not_a_date' "
    "ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS placed",
    "o_orderdate",
)

# Numbers and truth values as text.
TYPED = view(
    "orders",
    "o_orderkey",
    "CASE o_orderkey % 10 WHEN 0 THEN 'n/k' WHEN 1 THEN ' ' || CAST(o_custkey AS STRING) "
    "WHEN 2 THEN CAST(o_custkey AS STRING) || 'd' WHEN 3 THEN NULL "
    "ELSE CAST(o_custkey AS STRING) END AS amount",
    "CASE o_orderkey % 8 WHEN 0 THEN 'yes' WHEN 1 THEN ' NO ' WHEN 2 THEN 'True' WHEN 3 THEN '0' "
    "WHEN 4 THEN 'maybe' WHEN 5 THEN NULL WHEN 6 THEN '1.0' ELSE 'F' END AS flag",
    "o_orderstatus",
    "o_totalprice",
)

PARTS = view("part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
LINES = view(
    "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
)
TEXTS = view("documents", "doc_id", "text", "lang", "source")

# One row per order with every kind of issue; whole rows repeat.
MESSY = view(
    "orders",
    "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' || o_orderstatus "
    "WHEN 2 THEN lower(o_orderstatus) || 'x' WHEN 3 THEN '' ELSE o_orderstatus END AS status",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 211 = 0 THEN -1000.0 "
    "ELSE floor(o_totalprice / 50000.0) * 1.0 END AS price",
    "CASE WHEN o_orderkey % 5 = 4 THEN 'not_a_date' "
    "WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS placed",
    "CASE WHEN o_orderkey % 10 = 0 THEN 'n/k' ELSE CAST(o_custkey % 50 AS STRING) END AS amount",
    "CAST(1 AS BIGINT) AS constant",
)

# The same with row order.
MESSY_ORDERED = view("orders", *MESSY.expressions, "o_orderkey AS _row_id")


def shown_edges(bins: int, lower_first: bool = False) -> str:
    """WITH clause whose ``best`` has the edges of equal bins of ``value`` and how they print.

    Edges are rounded to the fewest decimals, from three, that keep them apart; below one these count from the
    first digit that is not zero. Doubles print in their shortest form.
    """
    scale = "power(10.0, CASE WHEN x <> 0 AND trunc(x) = 0 THEN d - 1 - floor(log10(abs(x))) ELSE d END)"
    rounded = f"round_even(x * {scale}, 0) / {scale}"
    shown = f"list_transform(edges, lambda x: {rounded})"
    first = f"(SELECT {rounded} FROM (SELECT shown[1] - power(10.0, -d) AS x))"
    listed = f"list_prepend({first}, shown[2:])" if lower_first else "shown"
    return (
        f"WITH e AS (SELECT [CASE i WHEN 0 THEN lo - 0.001 * (hi - lo) WHEN {bins} THEN hi ELSE lo + i * ((hi - lo) / {bins}) "
        f"END FOR i IN range({bins + 1})] AS edges FROM (SELECT min(value) AS lo, max(value) AS hi FROM {{t}})), "
        f"r AS (SELECT d, edges, {shown} AS shown FROM e, range(3, 20) g(d)), "
        f"b AS (SELECT * FROM r WHERE len(list_distinct(shown)) = {bins + 1} ORDER BY d LIMIT 1), "
        f"best AS (SELECT edges, {listed} AS shown FROM b) "
    )
