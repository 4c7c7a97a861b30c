"""Edges of columns that are longer than the ranges that are resolved cell by cell."""

from gridlineage.operators import edges, patterns
from gridlineage.sources import sheets


def test_long_columns_that_read_one_cell_each(spark):
    rows = spark.range(21_000).withColumnRenamed("id", "k")
    half = sheets.sheet_formulas(rows.filter("k % 2 = 0"), "S", "k", {5: "=A{r}*3"}).unionByName(sheets.sheet_formulas(rows.filter("k % 2 = 1"), "S", "k", {5: "=A{r}*4"}))
    f = patterns.relative(sheets.sheet_formulas(rows, "S", "k", {2: "=A{r}*2", 3: "=B{r}+1", 4: "=SUM(B$2:B{r})", 6: "=E{r}+2"}).unionByName(half)).cache()
    p = patterns.groups(f)
    kept, owned = patterns.top(p), patterns.owners(f, p)
    reads = edges.precedents(kept, sheets.dimensions(f))
    got = edges.merged(edges.range_edges(reads, owned, kept).unionByName(edges.approximate_edges(reads, kept)))
    b, e, f_ = "g:S!B2#21000", ("g:S!E2#10500", "g:S!E3#10500"), "g:S!F2#21000"
    assert {(r.src, r.dst, r.approx) for r in got.collect()} == {(b, "g:S!C2#21000", False), (b, "g:S!D2#21000", True), (e[0], f_, False), (e[1], f_, False)}
