"""Tables laid out as sheets: a header in row 1, the record with dense key k in row k + 2."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values

_NUMBERS = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.DecimalType)


def tagged(c: Column, kind: T.DataType) -> Column:
    """A column of a table as a cell value; null is blank."""
    if isinstance(kind, _NUMBERS):
        v = values.number(c.cast("double"))
    elif isinstance(kind, T.BooleanType):
        v = values.boolean(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        v = values.number(values.date_to_serial(c))
    else:
        v = values.text(c.cast("string"))
    return F.when(c.isNull(), values.blank()).otherwise(v)


def sheet_cells(df: DataFrame, sheet: str, key: str, columns: list[str] | None = None, workbook: str = "tables") -> DataFrame:
    """Sparse cells (workbook_id, sheet, row, col, value, is_date) of a table; blank cells have no row."""
    columns = columns or df.columns
    kinds = {f.name: f.dataType for f in df.schema}
    dated = (T.TimestampType, T.TimestampNTZType, T.DateType)
    each = [F.struct(F.lit(i).alias("col"), tagged(F.col(c), kinds[c]).alias("value"), F.lit(isinstance(kinds[c], dated)).alias("is_date")) for i, c in enumerate(columns, 1)]
    cells = df.select((F.col(key) + 2).cast("int").alias("row"), F.explode(F.array(*each)).alias("cell"))
    cells = cells.select(F.lit(workbook).alias("workbook_id"), F.lit(sheet).alias("sheet"), "row", "cell.*")
    return cells.filter(~F.col("value.kind").isin("blank") & ~F.coalesce(F.col("value.s") == "", F.lit(False)))


def filled(template: str, row: Column) -> Column:
    """A formula template with {r} (or {r-1}, {r+2}) replaced by row numbers."""
    parts = re.split(r"\{r([+-]\d+)?\}", template)
    out = [F.lit(parts[0])]
    for shift, rest in zip(parts[1::2], parts[2::2], strict=True):
        out += [(row + int(shift or 0)).cast("string"), F.lit(rest)]
    return F.concat(*out)


def sheet_formulas(df: DataFrame, sheet: str, key: str, templates: dict[int, str | Column], workbook: str = "tables") -> DataFrame:
    """Formula cells (workbook_id, sheet, row, col, formula): one column of formulas for each template."""
    row = (F.col(key) + 2).cast("int")
    each = [F.struct(F.lit(c).alias("col"), (filled(t, row) if isinstance(t, str) else t).alias("formula")) for c, t in templates.items()]
    return df.select(row.alias("row"), F.explode(F.array(*each)).alias("f")).select(F.lit(workbook).alias("workbook_id"), F.lit(sheet).alias("sheet"), "row", "f.col", "f.formula")


def dimensions(cells: DataFrame) -> DataFrame:
    """(workbook_id, sheet, max_row, max_col) of used cells."""
    return cells.groupBy("workbook_id", "sheet").agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
