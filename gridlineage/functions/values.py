"""Cell values as tagged structs, dates and serial numbers, comparisons, literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = "struct<kind: string, n: double, s: string, b: boolean, err: string>"
#: The errors that a cell can show.
ERRORS = ("#CALC!", "#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!", "#REF!", "#SPILL!", "#VALUE!")
NUMERAL = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def _value(kind: str, n=None, s=None, b=None, err=None) -> Column:
    part = lambda v, t: (F.lit(None) if v is None else v).cast(t)
    return F.struct(F.lit(kind).alias("kind"), part(n, "double").alias("n"), part(s, "string").alias("s"), part(b, "boolean").alias("b"), part(err, "string").alias("err"))


def number(n: Column) -> Column:
    return _value("num", n=n)


def text(s: Column) -> Column:
    return _value("text", s=s)


def boolean(b: Column) -> Column:
    return _value("bool", b=b)


def error(e: Column | str) -> Column:
    return _value("error", err=F.lit(e) if isinstance(e, str) else e)


def blank() -> Column:
    return _value("blank")


def uncomputed() -> Column:
    return _value("uncomputed")


def as_text(v: Column) -> Column:
    """A value as the & operator joins it: numbers of 15 digits, TRUE and FALSE, blank as nothing."""
    whole = F.when((v["n"] == F.floor(v["n"])) & (F.abs(v["n"]) < 1e15), v["n"].cast("long").cast("string")).otherwise(digits(v["n"]))
    return F.when(v["kind"] == "num", whole).when(v["kind"] == "text", v["s"]).when(v["kind"] == "bool", F.upper(v["b"].cast("string"))).when(v["kind"] == "error", v["err"]).otherwise("")


def digits(n: Column) -> Column:
    """A number by its 15 leading digits, without zeros at the end; with an exponent from 1E+15 on and below 0.0001."""
    e = F.format_string("%.14e", n)
    power = F.regexp_extract(e, r"e([+-]\d+)$", 1).try_cast("int")
    short = lambda t: F.regexp_replace(t, r"\.?0+$", "")
    far = F.concat(short(F.regexp_extract(e, r"^(-?\d\.\d+)", 1)), F.when(power < 0, "E-").otherwise("E+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    return F.when(F.isnan(n) | (F.abs(n) == float("inf")), n.cast("string")).when((power >= 15) | (power < -4), far).otherwise(short(e.try_cast("decimal(38,20)").cast("string")))


def as_number(v: Column) -> Column:
    """A value as arithmetic takes it: blank is 0, TRUE is 1, text that reads as a number is one; else null."""
    return F.when(v["kind"] == "num", v["n"]).when(v["kind"] == "blank", F.lit(0.0)).when(v["kind"] == "bool", v["b"].cast("double")).when((v["kind"] == "text") & v["s"].rlike(NUMERAL), v["s"].try_cast("double"))


def serial_to_date(serial: Column, epoch_1904: Column | bool = False) -> Column:
    """The date of a serial number; null before the epoch and for the day 60 of 1900, which never was.

    The 1900 system counts from 1899-12-31 below 60 and from 1899-12-30 above; the 1904 system from
    1904-01-01 as 0.
    """
    d = F.floor(serial).cast("int")
    old = F.when((serial < 1) | (d == 60), None).when(d < 60, F.date_add(F.lit("1899-12-31").cast("date"), d)).otherwise(F.date_add(F.lit("1899-12-30").cast("date"), d))
    new = F.when(serial >= 0, F.date_add(F.lit("1904-01-01").cast("date"), d))
    ok = serial.isNotNull() & ~F.isnan(serial) & (F.abs(serial) < 3_000_000)
    return F.when(ok, F.when(epoch_1904 if isinstance(epoch_1904, Column) else F.lit(epoch_1904), new).otherwise(old))


def date_to_serial(ts: Column, epoch_1904: bool = False) -> Column:
    """Days since the epoch, with the time as a fraction."""
    ts = ts.cast("timestamp_ntz")
    day = ts.cast("date")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.datediff(day, F.lit("1904-01-01" if epoch_1904 else "1899-12-30").cast("date")) + seconds / F.lit(86400.0)


def date_text(ts: Column) -> Column:
    """A date alone at midnight, else date and time."""
    ts = ts.cast("timestamp_ntz")
    clock = F.date_format(ts, "HH:mm:ss")
    return F.when(clock == "00:00:00", F.date_format(ts, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd "), clock))


def is_date_format(code: Column) -> Column:
    """Whether a number format shows a date or time: day, month, year, hour or second letters outside quotes and brackets."""
    bare = F.regexp_replace(code, r'"[^"]*"|\\.|\[[^\]]*\]|_.', "")
    return ~F.lower(bare).isin("general", "") & F.lower(bare).rlike("[dmyhs]")


def literal(v: Column) -> Column:
    """A value as a formula writes it."""
    return F.when(v["kind"] == "blank", "0").when(v["kind"] == "text", F.concat(F.lit('"'), F.replace(v["s"], F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(as_text(v))


def differ(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Whether a computed and a stored value disagree: numbers by more than the tolerance, error texts; else never."""
    numbers = (a["kind"] == "num") & (b["kind"] == "num")
    errors = (a["kind"] == "error") | (b["kind"] == "error")
    return F.when(numbers, F.abs(a["n"] - b["n"]) > tolerance).when(errors, ~F.coalesce(a["err"], F.lit("")).eqNullSafe(F.coalesce(b["err"], F.lit("")))).otherwise(False)


def json_safe(n: Column) -> Column:
    """A number as JSON can hold it: NaN and infinities as text."""
    return F.when(F.isnan(n), "nan").when(n == float("inf"), "inf").when(n == float("-inf"), "-inf").otherwise(n.cast("string"))
