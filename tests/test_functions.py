"""Address algebra, formula text and values against worked examples."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridlineage.functions import formulas as fo
from gridlineage.functions import refs as R
from gridlineage.functions import text as tx
from gridlineage.functions import values as V
from gridlineage.functions.programs import program


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_letters_both_ways(spark):
    rows = spark.range(1, 16_385).select("id", R.num_to_col(F.col("id")).alias("c")).withColumn("n", R.col_to_num(F.lower("c"))).collect()
    assert all(r.id == r.n for r in rows)
    assert {r.id: r.c for r in rows if r.id in (1, 26, 27, 702, 703, 16_384)} == {1: "A", 26: "Z", 27: "AA", 702: "ZZ", 703: "AAA", 16_384: "XFD"}


@pytest.mark.parametrize(
    ("ref", "want"),
    [
        ("A1", (None, 1, 1, 1, 1)), ("F7:K20", (None, 7, 6, 20, 11)), ("K20:F7", (None, 7, 6, 20, 11)), ("Beds!$H$12", ("Beds", 12, 8, 12, 8)), ("'Anna''s beds'!E4:G9", ("Anna's beds", 4, 5, 9, 7)),
        ("A:A", (None, 1, 1, 1_048_576, 1)), ("$1:3", (None, 1, 1, 3, 16_384)), ("rose", None), ("T[Col]", None), ("S1:S3!A1", None), ("A0", None), ("A1048577", None), ("XFE1", None), ("A1:", None), ("", None),
    ],
)
def test_references(spark, ref, want):
    r = one(spark, R.parse_ref(F.lit(ref)))
    assert (r and tuple(r)[:5]) == want


def test_references_written_again(spark):
    for ref, want in (("A1", "A1"), ("C3:A1", "A1:C3"), ("Beds!G8:G8", "Beds!G8"), ("'Old beds'!D6", "'Old beds'!D6"), ("'Anna''s'!D6", "'Anna''s'!D6")):
        assert one(spark, R.rect_to_a1(R.parse_ref(F.lit(ref)))) == want


def test_relative_forms(spark):
    at = (F.lit(5), F.lit(3))
    for f, want in (
        ("=A5*2", "RC[-2]*2"), ("=$A$1+A$5", "R1C1+R5C[-2]"), ("=SUM(C$1:C4)", "SUM(R1C:R[-1]C)"), ("=Yield*q", "Yield*q"), ("=XYZ1+S1:S2!A5", "XYZ1+'S1:S2'!RC[-2]"), ("=LOG10 (1)&T1.a", "LOG10 (1)&T1.a"), ("=#REF!A5", "#REF!RC[-2]"), ("='S 1'!B2&\"A1\"", "'S 1'!R[-3]C[-1]&\"A1\""), ("=LOG10(A5)", "LOG10(RC[-2])"), ("=SUM(C:C)", "SUM(C:C)"), ("=T[A1]", "T[A1]"),
    ):
        assert one(spark, fo.canonical_r1c1(F.lit(f), *at)) == want, f


def test_what_a_formula_reads(spark):
    for f, want in (
        ("=SUM(A1:B2)+A1+A1", ["A1:B2", "A1"]), ('=IF(TRUE,"A1",Rate)', ["Rate"]), ("=LET(x,A1,x*B1)", ["A1", "B1"]), ("=LET(x,A1,_xlpm.y,SUM(x,B1,z),x+y)", ["A1", "B1", "z"]), ("=LAMBDA(p,q,p*q+r)(A1,2)", ["r", "A1"]), ('="A1"&B2', ["B2"]), ("='[1]Y'!B4*T[c]", ["'[1]Y'!B4", "T[c]"]), ("=1+2", []),
    ):
        assert one(spark, fo.references(F.lit(f))) == want, f


def test_guards_and_keys(spark):
    for f, want in (('=IFERROR(A1,"x, y")', '"x, y"'), ("=IFNA(SUM(A1,B1),MAX(1,2))", "MAX(1,2)"), ("=IFERROR(A1,2)+1", None), ("=IFERROR(A1,2,3)", None), ("=A1", None)):
        assert one(spark, fo.guard_fallback(F.lit(f))) == want, f
    for f, want in (("=$A1 +  'B c'!D$2*LOG10(x)", "=@ + @*log10(x)"), ('="A1"&SUM(A1:B2)', '="a1"&sum(@:@)')):
        assert one(spark, fo.structural_key(F.lit(f))) == want, f


def test_flags(spark):
    for f, want in (('="NOW()"', False), ("=_xlfn.RANDARRAY(2)", True), ("=MYNOW()", False), ("=today ()", True)):
        assert one(spark, fo.is_volatile(F.lit(f))) == want, f
    sheets = F.array(F.lit("S"), F.lit("O'B"))
    for f, want in (("=S!A1", False), ("='O''B'!A1", False), ("=Gone!A1", True), ("=IFERROR(Gone!A1,1)", False), ("=[1]S!A1", True), ("=S1:S2!A1", True), ("=#REF!+1", False)):
        assert one(spark, fo.is_unresolvable(F.lit(f), sheets)) == want, f


@pytest.mark.parametrize(("f", "want"), [("=A1*(1-B1)", "A1 * (1 - B1)"), ("=A1-(B1-C1)", "A1 - (B1 - C1)"), ("=-A1^2", "-A1 ^ 2"), ("=A1%*2", "A1% * 2"), ("=(A1+B1)+C1", "A1 + B1 + C1")])
def test_rendering(f, want):
    assert program(f)["steps"][0]["expr"] == want


def test_what_is_no_formula():
    assert program("=SUM(A1:A3 A2:A3)") is None and program("=1+") is None and program("=(1") is None


def test_dates(spark):
    d = datetime.date
    for n, old, new in ((46300.0, d(2026, 10, 5), None), (61.0, d(1900, 3, 1), None), (1.0, d(1900, 1, 1), None), (59.0, d(1900, 2, 28), None), (60.0, None, None), (0.0, None, d(1904, 1, 1)), (-1.0, None, None)):
        assert one(spark, V.serial_to_date(F.lit(n))) == old
        if new:
            assert one(spark, V.serial_to_date(F.lit(n), True)) == new
    assert one(spark, V.serial_to_date(F.lit(float("nan")))) is None


def test_date_formats(spark):
    for code, want in (("yyyy-mm-dd", True), ("General", False), ('0.00" days"', False), ("[Red]0", False), ("h:mm", True)):
        assert one(spark, V.is_date_format(F.lit(code))) == want, code


def test_texts(spark):
    assert one(spark, tx.script_safe(F.lit('{"a":"</script>\u2028"}'))) == '{"a":"\\u003c/script>\\u2028"}'
    assert one(spark, tx.html_text(F.lit('<a href="x">&</a>'))) == "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"
    assert one(spark, tx.token_estimate(F.lit("one two three 日本"))) == 6
    header = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    assert tuple(one(spark, tx.png_size(F.lit(header)))) == (640, 480)
