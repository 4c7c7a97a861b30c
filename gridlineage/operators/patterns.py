"""Patterns: copies of one formula collapse into a group, its box, and samples of its members.

Formulas are grouped by their relative text with partial sums before the shuffle, so a column of a
hundred million copies sends a row for each task and pattern. Everything later works on patterns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formulas import canonical_r1c1, is_volatile
from ..functions.refs import a1, rect

#: Patterns of a sheet that are kept as nodes; the rest is summed up.
KEPT = 400
KEY = ("workbook_id", "sheet")


def relative(formulas: DataFrame) -> DataFrame:
    """Formula cells with `r1c1` and `volatile`; those that have both already are left as they are."""
    if {"r1c1", "volatile"} <= set(formulas.columns):
        return formulas
    return formulas.withColumns({"r1c1": canonical_r1c1(F.col("formula"), F.col("row"), F.col("col")), "volatile": is_volatile(F.col("formula"))})


def groups(formulas: DataFrame) -> DataFrame:
    """One row for each (workbook_id, sheet, r1c1): rep_row, rep_col, formula (of the first cell), cells, box, volatile."""
    first = F.min(F.struct("row", "col", "formula", "volatile"))
    out = relative(formulas).groupBy(*KEY, "r1c1").agg(first.alias("rep"), F.count("*").alias("cells"), F.min("row").alias("r1"), F.min("col").alias("c1"), F.max("row").alias("r2"), F.max("col").alias("c2"))
    box = rect(F.col("sheet"), F.col("r1"), F.col("c1"), F.col("r2"), F.col("c2"))
    return out.select(*KEY, "r1c1", F.col("rep.row").alias("rep_row"), F.col("rep.col").alias("rep_col"), F.col("rep.formula").alias("formula"), F.col("rep.volatile").alias("volatile"), "cells", box.alias("box"))


def ranked(patterns: DataFrame) -> DataFrame:
    """Patterns with `rank` in their sheet: most cells first, then the first representative."""
    return patterns.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("cells"), "rep_row", "rep_col")))


def top(patterns: DataFrame, kept: int = KEPT) -> DataFrame:
    """The `kept` largest patterns of each sheet, with a node id."""
    address = a1(F.col("rep_row"), F.col("rep_col"))
    single = F.concat(F.lit("c:"), F.col("sheet"), F.lit("!"), address)
    many = F.concat(F.lit("g:"), F.col("sheet"), F.lit("!"), address, F.lit("#"), F.col("cells").cast("string"))
    return ranked(patterns).filter(F.col("rank") <= kept).withColumn("node_id", F.when(F.col("cells") == 1, single).otherwise(many))


def rest(patterns: DataFrame, kept: int = KEPT) -> DataFrame:
    """What the other patterns of a sheet sum up to, cells and patterns: all of them less those that are kept, so that only few are ranked in one task."""
    sums = lambda df, c, n: df.groupBy(*KEY).agg(F.sum("cells").alias(c), F.count("*").alias(n))
    few = sums(ranked(patterns).filter(F.col("rank") <= kept), "_c", "_n")
    every = sums(patterns, "cells", "patterns").filter(F.col("patterns") > kept)
    return every.join(few, list(KEY)).select(*KEY, (F.col("cells") - F.col("_c")).alias("cells"), (F.col("patterns") - F.col("_n")).alias("patterns"))


def owners(formulas: DataFrame, patterns: DataFrame, kept: int = KEPT) -> DataFrame:
    """The node that owns each formula cell: its pattern's, or the sheet's `misc:` node."""
    ids = top(patterns, kept).select(*KEY, "r1c1", "node_id")
    owned = relative(formulas).select(*KEY, "row", "col", "r1c1").join(ids, [*KEY, "r1c1"], "left")
    return owned.select(*KEY, "row", "col", F.coalesce("node_id", F.concat(F.lit("misc:"), F.col("sheet"))).alias("node_id"))


def samples(formulas: DataFrame, n: int = 5) -> DataFrame:
    """At most n members of each pattern, evenly spaced, the first and last among them.

    Member i of m is taken where i is one of the rounded (half to even) steps k * (m - 1) / (n - 1). A
    pattern's members are numbered by counts of row ranges first, so no window holds a pattern whole.
    """
    cells = relative(formulas).select(*KEY, "r1c1", "row", "col", "formula")
    cells = cells.withColumn("part", F.floor(F.col("row") / 4096))
    parts = cells.groupBy(*KEY, "r1c1", "part").agg(F.count("*").alias("n"))
    of = Window.partitionBy(*KEY, "r1c1")
    before = parts.select(*KEY, "r1c1", "part", (F.sum("n").over(of.orderBy("part")) - F.col("n")).alias("base"), F.sum("n").over(of).alias("m"))
    place = F.row_number().over(Window.partitionBy(*KEY, "r1c1", "part").orderBy("row", "col")) - 1
    numbered = cells.withColumn("at", place).join(before, [*KEY, "r1c1", "part"]).withColumn("at", F.col("at") + F.col("base"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround(k * (F.col("m") - 1) / F.lit(float(n - 1))).cast("long"))
    return numbered.filter((F.col("m") <= n) | F.array_contains(steps, F.col("at"))).select(*KEY, "r1c1", "row", "col", "formula", "at")
