"""Address algebra on columns: letters and numbers, A1 and R1C1 references, rectangles.

A rectangle is a struct (sheet, r1, c1, r2, c2), 1-based and inclusive. Everything is a built-in expression,
so it stays inside generated code and can be pushed around by the optimizer.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grid of a spreadsheet, and the rows of one that a table is laid out on.
MAX_ROW, MAX_COL, TALL = 1_048_576, 16_384, 999_999_999
_rows: ContextVar[int] = ContextVar("rows", default=MAX_ROW)

#: Groups: $, letters, $, digits; and the same after a colon.
BODY = r"^\s*(\$?)([A-Za-z]{0,3})(\$?)([0-9]{0,9})\s*(:?)\s*(\$?)([A-Za-z]{0,3})(\$?)([0-9]{0,9})\s*$"
#: A sheet prefix: quoted (group 1) or bare (group 2).
PREFIX = r"^(?:'((?:[^']|'')*)'|([^'!]+))!"


@contextmanager
def grid(rows: int) -> Iterator[None]:
    """Expressions that are made inside take sheets to have so many rows."""
    before = _rows.set(rows)
    try:
        yield
    finally:
        _rows.reset(before)


def height() -> int:
    """Rows of a sheet: those of a spreadsheet, unless `grid` says otherwise."""
    return _rows.get()


def let(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def _groups(ref: Column) -> Column:
    """Sheet, and the nine groups of BODY, all taken by one match; the text itself where there is none."""
    mark = "\x01"
    taken = mark.join(f"${k}" for k in range(1, 10))
    return F.struct(sheet_of(ref).alias("sheet"), F.split(F.regexp_replace(body_of(ref), BODY, taken), mark).alias("p"))


def _group(p: Column):
    """The groups of BODY by number; where `p` has not nine parts, the text was no match."""
    return lambda k: F.get(p, F.lit(k - 1))


def col_to_num(letters: Column) -> Column:
    """Column number of up to three letters; case does not matter."""
    return let(F.upper(letters), _col_to_num)


def _col_to_num(u: Column) -> Column:
    at = lambda k: F.when(F.length(u) >= k, F.ascii(F.substring(u, -k, 1)) - 64).otherwise(0)
    return (at(1) + 26 * at(2) + 676 * at(3)).cast("int")


def num_to_col(n: Column) -> Column:
    """Letters of a column number from 1 to 16,384 (there is no zero digit)."""
    return let(n.cast("long"), _num_to_col)


def _num_to_col(n: Column) -> Column:
    letter = lambda c: F.chr(65 + c)
    third = F.when(n > 702, letter(F.floor((n - 703) / 676))).otherwise("")
    second = F.when(n > 26, letter(F.floor((n - 27) / 26) % 26)).otherwise("")
    return F.concat(third, second, letter((n - 1) % 26))


def a1(row: Column, col: Column) -> Column:
    return F.concat(num_to_col(col), row.cast("string"))


def quote_sheet(sheet: Column) -> Column:
    """The name as a formula needs it: quoted unless it is a plain identifier."""
    return F.when(sheet.rlike("^[A-Za-z_][A-Za-z0-9_.]*$"), sheet).otherwise(F.concat(F.lit("'"), F.replace(sheet, F.lit("'"), F.lit("''")), F.lit("'")))


def sheet_of(ref: Column) -> Column:
    """The sheet a reference names, or null."""
    quoted = F.replace(F.regexp_extract(ref, PREFIX, 1), F.lit("''"), F.lit("'"))
    bare = F.regexp_extract(ref, PREFIX, 2)
    return F.when(ref.contains("!") & ref.rlike(PREFIX), F.when(bare != "", bare).otherwise(quoted))


def body_of(ref: Column) -> Column:
    """A reference without its sheet."""
    return F.when(ref.contains("!"), F.regexp_replace(ref, PREFIX, "")).otherwise(ref)


def rect(sheet: Column, r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.struct(sheet.alias("sheet"), r1.cast("int").alias("r1"), c1.cast("int").alias("c1"), r2.cast("int").alias("r2"), c2.cast("int").alias("c2"))


def parse_ref(ref: Column, default_sheet: Column | None = None) -> Column:
    """Struct (sheet, r1, c1, r2, c2, r1_abs, c1_abs, r2_abs, c2_abs) of an A1 reference, or null.

    Cells, ranges, whole columns and whole rows are references; names, structured and 3-D references and
    cells beyond the grid are not. Corners are put in order; each keeps its own anchors. A whole axis
    counts as anchored.
    """
    return let(_groups(ref), lambda x: _parsed(x["sheet"], x["p"], default_sheet))


def _parsed(sheet: Column, p: Column, default_sheet: Column | None) -> Column:
    g = _group(p)
    letters, digits = (g(2), g(7)), (g(4), g(9))
    has = lambda c: c != ""
    pair = g(5) == ":"
    cell = ~pair & has(letters[0]) & has(digits[0])
    area = pair & has(letters[0]) & has(digits[0]) & has(letters[1]) & has(digits[1])
    columns = pair & has(letters[0]) & has(letters[1]) & ~has(digits[0]) & ~has(digits[1]) & (g(3) == "") & (g(8) == "")
    rows = pair & has(digits[0]) & has(digits[1]) & ~has(letters[0]) & ~has(letters[1])
    number = lambda k: F.when(has(digits[k]), digits[k].cast("int"))
    col = lambda k: F.when(has(letters[k]), col_to_num(letters[k]))
    found = {"columns": columns, "rows": rows, "some": cell | area | columns | rows, "pair": pair, "ra": number(0), "rb": number(1), "ca": col(0), "cb": col(1)}
    # Each is found once, however often it is named below.
    once = F.struct(*[c.alias(name) for name, c in found.items()])
    return F.when(F.size(p) == 9, let(once, lambda x: F.when(x["some"], _ordered(x, sheet, g, default_sheet))))


def _ordered(x: Column, sheet: Column, g, default_sheet: Column | None) -> Column:
    """A parsed reference with its corners in order, or null where it lies beyond the grid."""
    pair, columns, rows = x["pair"], x["columns"], x["rows"]
    ra, rb = x["ra"], F.when(pair, x["rb"]).otherwise(x["ra"])
    ca, cb = x["ca"], F.when(pair, x["cb"]).otherwise(x["ca"])
    row_a = F.when(rows, (g(1) == "$") | (g(3) == "$")).otherwise(g(3) == "$")
    row_b = F.when(rows, (g(6) == "$") | (g(8) == "$")).otherwise(F.when(pair, g(8) == "$").otherwise(g(3) == "$"))
    col_a, col_b = g(1) == "$", F.when(pair, g(6) == "$").otherwise(g(1) == "$")
    swap_r, swap_c = ra > rb, ca > cb
    low = F.coalesce(F.least(ra, rb), F.lit(1))
    left = F.coalesce(F.least(ca, cb), F.lit(1))
    high = F.when(columns, height()).otherwise(F.greatest(ra, rb))
    right = F.when(rows, MAX_COL).otherwise(F.greatest(ca, cb))
    ok = (low >= 1) & (high <= height()) & (right <= MAX_COL) & ~F.coalesce(sheet.contains(":"), F.lit(False))
    flag = lambda swap, x, y, whole: F.when(whole, True).otherwise(F.when(swap, y).otherwise(x))
    where = sheet if default_sheet is None else F.coalesce(sheet, default_sheet)
    return F.when(
        ok,
        F.struct(
            where.alias("sheet"), low.cast("int").alias("r1"), left.cast("int").alias("c1"), high.cast("int").alias("r2"), right.cast("int").alias("c2"),
            flag(swap_r, row_a, row_b, columns).alias("r1_abs"), flag(swap_c, col_a, col_b, rows).alias("c1_abs"), flag(swap_r, row_b, row_a, columns).alias("r2_abs"), flag(swap_c, col_b, col_a, rows).alias("c2_abs"),
        ),
    )


def ncells(r: Column) -> Column:
    return let(r, lambda x: (x["r2"] - x["r1"] + 1).cast("long") * (x["c2"] - x["c1"] + 1).cast("long"))


def rect_to_a1(r: Column) -> Column:
    """`Sheet!A1:B2`; one cell is written once, a missing sheet not at all."""
    return let(r, _rect_to_a1)


def _rect_to_a1(r: Column) -> Column:
    start, end = a1(r["r1"], r["c1"]), a1(r["r2"], r["c2"])
    addr = F.when(start == end, start).otherwise(F.concat(start, F.lit(":"), end))
    return F.when(r["sheet"].isNull(), addr).otherwise(F.concat(quote_sheet(r["sheet"]), F.lit("!"), addr))


def clipped(r: Column, max_row: Column, max_col: Column) -> Column:
    """The part inside a sheet's used dimensions (of one row and column at least), or null."""
    return let(F.struct(r.alias("r"), max_row.alias("rows"), max_col.alias("cols")), lambda x: _clipped(x["r"], x["rows"], x["cols"]))


def _clipped(r: Column, max_row: Column, max_col: Column) -> Column:
    r2, c2 = F.least(r["r2"], F.greatest(max_row, F.lit(1))), F.least(r["c2"], F.greatest(max_col, F.lit(1)))
    return F.when((r2 >= r["r1"]) & (c2 >= r["c1"]), rect(r["sheet"], r["r1"], r["c1"], r2, c2))


def intersects(a: Column, b: Column) -> Column:
    return (a["r1"] <= b["r2"]) & (b["r1"] <= a["r2"]) & (a["c1"] <= b["c2"]) & (b["c1"] <= a["c2"])


def stretched(d: Column, rep_row: Column, rep_col: Column, box: Column) -> Column:
    """A representative's reference moved over its whole group: relative ends follow the box, anchored ends stay."""
    return let(F.struct(d.alias("d"), rep_row.alias("row"), rep_col.alias("col"), box.alias("box")), lambda x: _stretched(x["d"], x["row"], x["col"], x["box"]))


def _stretched(d: Column, rep_row: Column, rep_col: Column, box: Column) -> Column:
    r1 = F.when(d["r1_abs"], d["r1"]).otherwise(d["r1"] + box["r1"] - rep_row)
    r2 = F.when(d["r2_abs"], d["r2"]).otherwise(d["r2"] + box["r2"] - rep_row)
    c1 = F.when(d["c1_abs"], d["c1"]).otherwise(d["c1"] + box["c1"] - rep_col)
    c2 = F.when(d["c2_abs"], d["c2"]).otherwise(d["c2"] + box["c2"] - rep_col)
    floor, row, col = F.lit(1), F.lit(height()), F.lit(MAX_COL)
    return rect(d["sheet"], F.greatest(floor, F.least(r1, r2)), F.greatest(floor, F.least(c1, c2)), F.least(row, F.greatest(r1, r2)), F.least(col, F.greatest(c1, c2)))


def _relative(axis: str, anchored: Column, at: Column, base: Column) -> Column:
    moved = lambda d: F.when(d == 0, F.lit(axis)).otherwise(F.concat(F.lit(f"{axis}["), d.cast("string"), F.lit("]")))
    return F.when(anchored, F.concat(F.lit(axis), at.cast("string"))).otherwise(let(at - base, moved))


def ref_to_r1c1(ref: Column, row: Column, col: Column) -> Column:
    """An A1 reference relative to its host cell, ends in the order written; null where it is no reference."""
    return let(_groups(ref), lambda x: _relative_ref(x["sheet"], x["p"], row, col))


def _relative_ref(sheet: Column, p: Column, row: Column, col: Column) -> Column:
    g = _group(p)

    def end(k: int) -> Column:
        dollar, letters, dollar2, digits = g(k), g(k + 1), g(k + 2), g(k + 3)
        r = F.when(digits != "", _relative("R", (dollar2 == "$") | ((letters == "") & (dollar == "$")), digits.cast("int"), row)).otherwise("")
        c = F.when(letters != "", _relative("C", dollar == "$", col_to_num(letters), col)).otherwise("")
        return F.concat(r, c)

    out = F.when(g(5) == ":", F.concat(end(1), F.lit(":"), end(6))).otherwise(end(1))
    out = F.when(sheet.isNull(), out).otherwise(F.concat(quote_sheet(sheet), F.lit("!"), out))
    full = (g(2) != "") | (g(4) != "")
    whole = (g(5) == ":") & full & ((g(7) != "") | (g(9) != ""))
    fits = F.lit(True)
    for k in (1, 6):
        fits &= (F.length(g(k + 1)) < 3) | (col_to_num(g(k + 1)) <= MAX_COL)
        fits &= (F.length(g(k + 3)) < 7) | (g(k + 3).cast("int") <= height())
    return F.when((F.size(p) == 9) & (whole | ((g(5) == "") & (g(2) != "") & (g(4) != ""))) & fits, out)
