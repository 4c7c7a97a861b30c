"""Columns of lookups and conditional sums as joins and group-bys.

A million VLOOKUPs down a column are one join; a million SUMIFS are one aggregation and a join. Values are
tagged; errors travel. The first match is found with a minimum over row numbers before the join, so a key
that repeats does not multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


def first_match(table: DataFrame, key: str, value: str, row: str) -> DataFrame:
    """(key, value) of the smallest row for each key."""
    return table.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(value, row).alias("_found"), F.min(row).alias("_row"))


def lookup(asks: DataFrame, ask: str, table: DataFrame, key: str, value: str, row: str, default: Column | None = None, out: str = "result") -> DataFrame:
    """Exact lookup of `ask` in the table's `key` column: the value of its first match, else `default` or #N/A (a tagged value).

    VLOOKUP with FALSE, XLOOKUP and INDEX with MATCH are all this. `value` is a tagged value column.
    """
    found = first_match(table, key, value, row)
    missing = V.error("#N/A") if default is None else default
    return asks.join(found, asks[ask] == found["_key"], "left").withColumn(out, F.when(F.col("_row").isNull(), missing).otherwise(F.col("_found"))).drop("_key", "_found", "_row")


def match(asks: DataFrame, ask: str, table: DataFrame, key: str, row: str, out: str = "result") -> DataFrame:
    """Position (from 1) of the first exact match, or #N/A."""
    found = table.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(row).alias("_row"))
    hit = asks.join(found, asks[ask] == found["_key"], "left")
    return hit.withColumn(out, F.when(F.col("_row").isNull(), V.error("#N/A")).otherwise(V.number(F.col("_row")))).drop("_key", "_row")


def conditional(asks: DataFrame, on: dict[str, str], table: DataFrame, value: str | None, condition: Column | None = None, out: str = "result") -> DataFrame:
    """SUMIFS (or COUNTIFS, without `value`) for a column of criteria: equal columns in `on`, and a fixed condition.

    The table is aggregated by its criteria columns before the join.
    """
    rows = table if condition is None else table.filter(condition)
    measure = F.count("*").cast("double") if value is None else F.sum(F.col(value))
    sums = rows.groupBy(*[F.col(t).alias(f"_{a}") for a, t in on.items()]).agg(measure.alias("_sum"))
    hit = None
    for a in on:
        c = asks[a] == sums[f"_{a}"]
        hit = c if hit is None else hit & c
    return asks.join(sums, hit, "left").withColumn(out, F.coalesce(F.col("_sum"), F.lit(0.0))).drop("_sum", *[f"_{a}" for a in on])


def sum_product(rows: DataFrame, *columns: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum of products of row-aligned columns; what is no number counts as 0."""
    product = F.lit(1.0)
    for c in columns:
        product = product * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return rows.groupBy(*by).agg(F.sum(product).alias("result"))


def sum_without_errors(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """AGGREGATE(9, 6, range): the sum of numbers, errors left out."""
    return rows.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col(value)["kind"] == "num", F.col(value)["n"])), F.lit(0.0)).alias("result"))


def text_join(rows: DataFrame, value: str, order: tuple[str, ...], separator: str, by: tuple[str, ...] = ()) -> DataFrame:
    """TEXTJOIN with TRUE: texts of non-blank cells in the order of the cells."""
    own = V.as_text(F.col(value))
    parts = F.sort_array(F.collect_list(F.struct(*order, own.alias("_text"))))
    return rows.filter(own != "").groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["_text"]), separator).alias("result"))
