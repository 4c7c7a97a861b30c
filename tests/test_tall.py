"""Tables with more rows than a spreadsheet has."""

import pytest
from pyspark.sql import functions as F

from gridlineage.functions import formulas as fo
from gridlineage.functions import refs as R
from gridlineage.functions import values as V
from gridlineage.operators import evaluate
from gridlineage.queries import QUERIES
from gridlineage.sources import sheets

FAR = 36_000_000


def test_references_below_a_spreadsheet(spark):
    ref, text = F.lit("S!$A$2:B36000000"), F.concat(F.lit("=A"), F.col("id").cast("string"), F.lit("*2"))
    below = spark.range(FAR, FAR + 3)
    assert below.select(R.parse_ref(ref).alias("r")).first().r is None
    with R.grid(R.TALL):
        r = below.select(R.parse_ref(ref).alias("r")).first().r
        keys = below.select(fo.canonical_r1c1(text, F.col("id"), F.lit(2)).alias("k")).distinct().collect()
    assert (r.sheet, r.r1, r.c1, r.r2, r.c2) == ("S", 2, 1, FAR, 2)
    assert [k.k for k in keys] == ["RC[-1]*2"]
    assert below.select(fo.canonical_r1c1(text, F.col("id"), F.lit(2)).alias("k")).distinct().count() == 3


def test_values_below_a_spreadsheet(spark):
    rows = spark.range(FAR, FAR + 40).withColumnRenamed("id", "k")
    cells = rows.select(F.lit("w").alias("workbook_id"), F.lit("S").alias("sheet"), (F.col("k") + 2).cast("int").alias("row"), F.lit(1).alias("col"), V.number((F.col("k") - FAR).cast("double")).alias("value"))
    f = sheets.sheet_formulas(rows, "S", "k", {2: "=SUM(A$2:A{r})", 3: "=C{r-1}+A{r}", 4: f"=MATCH(A{{r}},A${FAR}:A${FAR + 41},0)", 5: f"=COUNTIF(A$2:A{{r}},\">=\"&{20})", 6: "=MATCH(A{r},A$36000000:A{r},0)"}, "w")
    with R.grid(R.TALL):
        got = {(r.row - FAR - 2, r.col): r.n for r in evaluate.evaluate(f, cells).select("row", "col", "value.n").collect()}
    for k in range(40):
        assert [got[k, c] for c in range(2, 7)] == [k * (k + 1) / 2, k * (k + 1) / 2, k + 3, max(0, k - 19), k + 3], k


@pytest.mark.parametrize("name", ["parse_refs", "pattern_groups", "eval_ranges"])
def test_queries_below_a_spreadsheet(spark, tmp_path, name):
    keys = F.explode(F.array(*[F.lit(k) for k in (0, 1, 2, 1_048_573, 1_048_574, 1_048_575, 2_000_000, FAR)]))
    day = F.lit("2024-01-01").cast("timestamp_ntz")
    spark.range(1).select(keys.alias("k")).select(F.col("k").cast("long").alias("o_orderkey")).select("o_orderkey", (F.col("o_orderkey") % 7).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit(2.5).alias("o_totalprice"), day.alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    rows = QUERIES[name](spark, str(tmp_path)).collect()
    if name == "parse_refs":
        assert all(r.r2 == max(r.o_orderkey + 2, r.o_orderkey % 7 + 1) for r in rows)
    elif name == "pattern_groups":
        assert [(r.cells, r.box) for r in rows] == [(8, f"orders!G2:G{FAR + 2}")]
    else:
        assert [(r.total, r.mean, r.numbers, r.filled) for r in rows] == [(20.0, 2.5, 8.0, 8.0)]
