"""Edges: what each pattern reads, resolved to the nodes that own the cells.

A range is matched with cells by an equi join on bins of 1,024 rows and a check inside the bin, never by a
bare BETWEEN; a range that spans many bins is replicated to each, so no task holds all cells of a sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import references
from ..functions.refs import clipped, intersects, ncells, parse_ref, rect_to_a1, stretched
from .ordered import small

BIN = 1024
#: Ranges up to this many cells are resolved cell by cell, larger ones by the boxes of patterns. What counts is what one cell reads: a column that reads the cell beside it reads one.
EXACT_CELLS = 20_000


def precedents(patterns: DataFrame, sheets: DataFrame) -> DataFrame:
    """One row for each distinct range, name or opaque reference that a pattern reads.

    `patterns` has workbook_id, sheet, node_id, formula, rep_row, rep_col, box; `sheets` the dimensions.
    kind is rect (with `target` stretched over the group and clipped to the sheet, and `each`, the most cells that one
    member reads of it), name or opaque.
    """
    refs = patterns.select("workbook_id", "sheet", "node_id", "rep_row", "rep_col", "box", F.explode(references(F.col("formula"))).alias("ref"))
    refs = refs.withColumn("detail", parse_ref(F.col("ref"), F.col("sheet")))
    wide = stretched(F.col("detail"), F.col("rep_row"), F.col("rep_col"), F.col("box"))
    refs = refs.withColumn("target", F.when(F.col("detail").isNotNull(), wide)).withColumn("on", F.col("target.sheet"))
    dims = sheets.select("workbook_id", F.col("sheet").alias("on"), "max_row", "max_col")
    refs = refs.join(dims, ["workbook_id", "on"], "left")
    named = F.col("detail").isNull() & F.col("ref").rlike(r"^[A-Za-z_\\][\w.]*$")
    kind = F.when(named, "name").when(F.col("detail").isNull() | F.col("max_row").isNull(), "opaque").otherwise("rect")
    d = F.col("detail")
    grows = (d["r1_abs"] != d["r2_abs"]) | (d["c1_abs"] != d["c2_abs"])
    refs = refs.withColumn("each", F.when(kind == "rect", F.when(grows, ncells(F.col("target"))).otherwise(ncells(d))))
    out = refs.withColumn("kind", kind).withColumn("target", F.when(F.col("kind") == "rect", clipped(F.col("target"), F.col("max_row"), F.col("max_col"))))
    return out.filter((F.col("kind") != "rect") | F.col("target").isNotNull()).select("workbook_id", "sheet", "node_id", "kind", F.when(F.col("kind") != "rect", F.col("ref")).alias("ref"), "target", F.least("each", ncells(F.col("target"))).alias("each")).distinct()


def _bins(r: Column) -> Column:
    return F.explode(F.sequence(F.floor(r["r1"] / BIN), F.floor(r["r2"] / BIN)))


def cells_in(ranges: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs of ranges (workbook_id, target, ...) and the cells (workbook_id, sheet, row, col, ...) inside them."""
    left = ranges.select("*", F.col("target.sheet").alias("_sheet"), _bins(F.col("target")).alias("_bin"))
    right = cells.select(*[F.col(c).alias(f"cell_{c}") if c not in ("workbook_id",) else F.col(c) for c in cells.columns], F.col("sheet").alias("_sheet"), F.floor(F.col("row") / BIN).alias("_bin"))
    t = F.col("target")
    inside = F.col("cell_row").between(t["r1"], t["r2"]) & F.col("cell_col").between(t["c1"], t["c2"])
    return left.join(right, ["workbook_id", "_sheet", "_bin"]).filter(inside).drop("_sheet", "_bin")


def range_edges(reads: DataFrame, owned: DataFrame, kept: DataFrame, exact: int = EXACT_CELLS) -> DataFrame:
    """(workbook_id, src, dst, kind, approx) from owners of cells to the nodes that read them; ranges of which each cell reads few only.

    Where such ranges are long, a pattern that fills its box (of those `kept`) is met where its box is; cells of the others are looked at.
    """
    few = reads.filter((F.col("kind") == "rect") & (F.col("each") <= exact)).select("workbook_id", F.col("node_id").alias("dst"), "target")
    long = ncells(F.col("target")) > exact
    full = kept.filter(F.col("cells") == ncells(F.col("box")))
    gaps = owned.join(small(full.select("workbook_id", "sheet", "node_id")), ["workbook_id", "sheet", "node_id"], "left_anti")
    own = lambda pairs: pairs.select("workbook_id", F.col("cell_node_id").alias("src"), "dst")
    pairs = own(cells_in(few.filter(~long), owned)).unionByName(own(cells_in(few.filter(long), gaps))).unionByName(_met(few.filter(long), full))
    return pairs.filter("src <> dst").distinct().select("*", F.lit("dep").alias("kind"), F.lit(False).alias("approx"))


def _met(ranges: DataFrame, kept: DataFrame) -> DataFrame:
    """(workbook_id, src, dst): patterns whose box meets a range of the same sheet."""
    boxes = kept.select("workbook_id", F.col("sheet").alias("_sheet"), F.col("node_id").alias("src"), "box")
    pairs = ranges.withColumn("_sheet", F.col("target.sheet")).join(boxes, ["workbook_id", "_sheet"])
    return pairs.filter(intersects(F.col("target"), F.col("box"))).select("workbook_id", "src", "dst")


def input_ranges(reads: DataFrame, owned: DataFrame, exact: int = EXACT_CELLS) -> DataFrame:
    """(workbook_id, node_id, target, formulas): ranges with a cell that no formula owns.

    Such a range is an input as a whole. It is found by counting: fewer formula cells than cells. Ranges
    above `exact` cells always count as inputs.
    """
    rects = reads.filter(F.col("kind") == "rect").select("workbook_id", "target").distinct()
    small_ = rects.filter(ncells(F.col("target")) <= exact)
    held = cells_in(small_, owned).groupBy("workbook_id", "target").agg(F.count("*").alias("formulas"))
    out = rects.join(held, ["workbook_id", "target"], "left").withColumn("formulas", F.coalesce("formulas", F.lit(0)))
    return out.filter((ncells(F.col("target")) > exact) | (F.col("formulas") < ncells(F.col("target")))).withColumn("node_id", F.concat(F.lit("i:"), rect_to_a1(F.col("target"))))


def input_edges(reads: DataFrame, inputs: DataFrame) -> DataFrame:
    """Edges from input ranges to the nodes that read them."""
    rects = reads.filter(F.col("kind") == "rect").select("workbook_id", "target", F.col("node_id").alias("dst"))
    out = rects.join(inputs.select("workbook_id", "target", F.col("node_id").alias("src")), ["workbook_id", "target"])
    return out.select("workbook_id", "src", "dst", F.lit("dep").alias("kind"), F.lit(False).alias("approx")).distinct()


def approximate_edges(reads: DataFrame, kept: DataFrame, exact: int = EXACT_CELLS) -> DataFrame:
    """Edges from patterns whose box meets a range of which one cell reads a large part; kept patterns alone take part."""
    far = reads.filter((F.col("kind") == "rect") & (F.col("each") > exact)).select("workbook_id", F.col("node_id").alias("dst"), "target")
    return _met(far, kept).filter("src <> dst").select("*", F.lit("dep").alias("kind"), F.lit(True).alias("approx")).distinct()


def merged(edges: DataFrame) -> DataFrame:
    """Edges once each; one that is exact anywhere is exact. Self-edges go."""
    return edges.filter("src <> dst").groupBy("workbook_id", "src", "dst", "kind").agg(F.expr("bool_and(approx)").alias("approx"))


def name_edges(reads: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges from defined names to the nodes that use them, and the uses that no name explains (opaque nodes).

    `names` has workbook_id and name; names match without case.
    """
    uses = reads.filter(F.col("kind") != "rect").select("workbook_id", F.col("node_id").alias("dst"), "ref", "kind", F.upper("ref").alias("key"))
    known = names.select("workbook_id", "name", F.upper("name").alias("key"))
    found = uses.join(known, ["workbook_id", "key"], "left")
    edges = found.filter("name is not null").select("workbook_id", F.concat(F.lit("n:"), F.col("name")).alias("src"), "dst", F.lit("name").alias("kind"), F.lit(False).alias("approx"))
    opaque = found.filter("name is null").select("workbook_id", F.concat(F.lit("x:"), F.col("ref")).alias("src"), "dst", F.lit("dep").alias("kind"), F.lit(False).alias("approx"))
    return edges.distinct(), opaque.distinct()


def name_reads(names: DataFrame) -> DataFrame:
    """Targets of names (workbook_id, name, targets array<rect>) as ranges that the name's node reads."""
    reads = names.select("workbook_id", F.lit(None).cast("string").alias("sheet"), F.concat(F.lit("n:"), F.col("name")).alias("node_id"), F.lit("rect").alias("kind"), F.lit(None).cast("string").alias("ref"), F.explode("targets").alias("target"))
    return reads.withColumn("each", ncells(F.col("target")))
