"""What a reader is shown of sheets, ranges and workbooks: examples, heads of ranges, previews, dates, dossiers of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import refs as R
from ..functions import values as V
from .edges import cells_in
from .patterns import KEY, relative

#: Example formulas of a pattern; side of the corner of a range and values taken from it; rows and columns of a preview.
EXAMPLES, CORNER, HEAD, ROWS, COLUMNS = 3, 5, 5, 12, 8
#: Characters of a workbook's dossier, and what the steps of the ladder leave: rows of previews, patterns, procedures.
LONGEST, FEW_ROWS, PATTERNS, FEW_PATTERNS, FEW_PROCEDURES = 16_000, 4, 20, 5, 10
#: Sheets that the last steps of the ladder list at most; the others are counted.
FEW_SHEETS = (200, 20)


def _first(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group with their `rank`; tasks drop the rest before they shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def examples(formulas: DataFrame, n: int = EXAMPLES) -> DataFrame:
    """(KEY, r1c1, examples): the formulas of the first n members of each pattern, by row and column."""
    cells = relative(formulas).select(*KEY, "r1c1", "row", "col", "formula")
    few = _first(cells, [*KEY, "r1c1"], ["row", "col"], n)
    return few.groupBy(*KEY, "r1c1").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "formula"))), lambda x: x["formula"]).alias("examples"))


def heads(ranges: DataFrame, values: DataFrame, n: int = HEAD, corner: int = CORNER) -> DataFrame:
    """(workbook_id, target, head): the first n values in row order of a range's corner of corner x corner cells, as texts."""
    t = F.col("target")
    cut = ranges.select("workbook_id", F.struct(*[t[f].alias(f) for f in ("sheet", "r1", "c1", "r2", "c2")]).alias("whole")).distinct()
    w = F.col("whole")
    cut = cut.withColumn("target", R.rect(w["sheet"], w["r1"], w["c1"], F.least(w["r2"], w["r1"] + corner - 1), F.least(w["c2"], w["c1"] + corner - 1)))
    inside = cells_in(cut, values.filter("value.kind <> 'blank'")).select("workbook_id", "whole", "cell_row", "cell_col", V.as_text(F.col("cell_value")).alias("text"))
    few = _first(inside, ["workbook_id", "whole"], ["cell_row", "cell_col"], n)
    return few.groupBy("workbook_id", F.col("whole").alias("target")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("head"))


def dated(values: DataFrame, cells: DataFrame, structure: DataFrame) -> DataFrame:
    """`values` with `date`: the date of a number in a cell of a date format, by the epoch of its workbook."""
    place = [*KEY, "row", "col"]
    epoch = structure.filter("kind = 'epoch'").select("workbook_id", F.lit(True).alias("new")).distinct()
    marked = cells.filter("is_date").select(*place, F.lit(True).alias("is_date"))
    out = values.join(marked, place, "left").join(F.broadcast(epoch), "workbook_id", "left")
    date = V.serial_to_date(F.col("value.n"), F.coalesce("new", F.lit(False)))
    return out.withColumn("date", F.when(F.col("is_date") & (F.col("value.kind") == "num"), date)).drop("is_date", "new")


def shown(reads: DataFrame, values: DataFrame, names: DataFrame) -> DataFrame:
    """`reads` (workbook_id, kind, ref, target) with `preview`: a cell's value, a range with the count of its cells, what a name stands for; else null."""
    t, n = F.col("target"), R.ncells(F.col("target"))
    at = values.select("workbook_id", F.col("sheet").alias("_sheet"), F.col("row").alias("_row"), F.col("col").alias("_col"), V.as_text(F.col("value")).alias("_text"))
    keyed = reads.withColumns({"_sheet": F.when(n == 1, t["sheet"]), "_row": F.when(n == 1, t["r1"]), "_col": F.when(n == 1, t["c1"]), "_key": F.when(F.col("kind") == "name", F.upper("ref"))})
    known = names.select("workbook_id", F.upper("name").alias("_key"), R.rect_to_a1(F.col("targets")[0]).alias("_stands"))
    out = keyed.join(at, ["workbook_id", "_sheet", "_row", "_col"], "left").join(known, ["workbook_id", "_key"], "left")
    many = F.when(n > 1, F.concat(R.rect_to_a1(t), F.lit(" ("), n.cast("string"), F.lit(")")))
    return out.withColumn("preview", F.coalesce("_stands", "_text", many)).drop("_sheet", "_row", "_col", "_key", "_stands", "_text")


def previews(cells: DataFrame, rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """(KEY, preview): the corner of each sheet as rows of texts, without blanks at their ends and without empty rows."""
    corner = cells.filter((F.col("row") <= rows) & (F.col("col") <= columns)).select(*KEY, "row", "col", V.as_text(F.col("value")).alias("text")).filter("text <> ''")
    by_row = corner.groupBy(*KEY, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("texts"), F.max("col").alias("last"))
    line = F.transform(F.sequence(F.lit(1), F.col("last")), lambda c: F.coalesce(F.try_element_at("texts", c), F.lit("")))
    return by_row.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("row", line.alias("texts")))).alias("preview"))


def sheet_context(structure: DataFrame, facts: DataFrame) -> DataFrame:
    """Declared sheets (name, state, order) with what is known of them (`facts`, by KEY), and sheets that only one side has."""
    declared = structure.filter("kind = 'sheet'").select("workbook_id", "sheet", "ord", F.col("text").alias("state"))
    return declared.join(facts, list(KEY), "full")


def listed(df: DataFrame, order: list[str], most: int | None, name: str, *columns: str) -> DataFrame:
    """(workbook_id, name): the rows of each workbook (or `most` of them) in order, as an array of structs."""
    few = _first(df, ["workbook_id"], order, 2**31 - 1 if most is None else most)
    return few.groupBy("workbook_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.struct(*columns).alias("x")))), lambda r: r["x"]).alias(name))


def ladder(versions: list[Column], longest: int) -> Column:
    """The first of some texts that is short enough, else the last."""
    out = versions[-1]
    for v in reversed(versions[:-1]):
        out = F.when(F.length(v) <= longest, v).otherwise(out)
    return out


def workbook_dossiers(structure: DataFrame, cells: DataFrame, patterns: DataFrame, formulas: DataFrame, procedures: DataFrame | None = None, longest: int = LONGEST) -> DataFrame:
    """(workbook_id, dossier): one JSON text for each workbook: its sheets with previews and comments, and its largest patterns and procedures.

    What is too long sheds parts: previews keep FEW_ROWS rows, then FEW_PATTERNS patterns and FEW_PROCEDURES
    procedures are left, then previews and comments go, then sheets above FEW_SHEETS; what is left out is counted
    (sheets_left, patterns_left, procedures_left).
    """
    counts = formulas.groupBy(*KEY).agg(F.count("*").alias("formulas"))
    comments = structure.filter("kind = 'comment'").groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("name", "text"))).alias("comments"))
    facts = previews(cells).join(counts, list(KEY), "full").join(comments, list(KEY), "full")
    sheets = listed(sheet_context(structure, facts).fillna({"formulas": 0}), [F.asc_nulls_last("ord"), "sheet"], None, "sheets", "sheet", "state", "formulas", "preview", "comments")
    largest = listed(patterns, [F.desc("cells"), "sheet", "rep_row", "rep_col"], PATTERNS, "patterns", "sheet", "r1c1", "formula", "cells")
    whole = structure.select("workbook_id").distinct().join(sheets, "workbook_id", "left").join(largest, "workbook_id", "left")
    if procedures is not None:
        whole = whole.join(listed(procedures, ["module", "proc"], None, "procedures", "module", "proc", "kind"), "workbook_id", "left")
    else:
        whole = whole.withColumn("procedures", F.lit(None).cast("array<struct<module: string, proc: string, kind: string>>"))
    keep = lambda s, rows, notes: F.struct(s["sheet"].alias("sheet"), s["state"].alias("state"), s["formulas"].alias("formulas"), *([F.slice(s["preview"], 1, rows).alias("preview")] if rows else []), *([s["comments"].alias("comments")] if notes else []))

    def version(rows: int, notes: bool, few: bool, most: int | None = None) -> Column:
        cut = lambda c, n: F.slice(c, 1, n) if n and (few or c == "sheets") else F.col(c)
        left = lambda c, n: F.when(F.size(c) > n, F.size(c) - n).alias(f"{c}_left")
        gone = ([left("patterns", FEW_PATTERNS), left("procedures", FEW_PROCEDURES)] if few else []) + ([left("sheets", most)] if most else [])
        return F.to_json(F.struct("workbook_id", F.transform(cut("sheets", most), lambda s: keep(s, rows, notes)).alias("sheets"), cut("patterns", FEW_PATTERNS).alias("patterns"), cut("procedures", FEW_PROCEDURES).alias("procedures"), *gone))

    steps = [version(ROWS, True, False), version(FEW_ROWS, True, False), version(FEW_ROWS, True, True), version(0, False, True), *(version(0, False, True, k) for k in FEW_SHEETS)]
    return whole.select("workbook_id", ladder(steps, longest).alias("dossier"))
