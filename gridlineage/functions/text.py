"""Text functions: escapes for JSON in scripts and for HTML, token estimates, truncation, image sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges of characters that count as a token each.
CJK = r"[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]"


def script_safe(json: Column) -> Column:
    """JSON that may stand inside a script element."""
    out = F.replace(json, F.lit("<"), F.lit("\\u003c"))
    return F.replace(F.replace(out, F.lit("\u2028"), F.lit("\\u2028")), F.lit("\u2029"), F.lit("\\u2029"))


def html_text(text: Column) -> Column:
    """Text that may stand inside an element or a quoted attribute."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def token_estimate(text: Column) -> Column:
    """Rough count of a language model's tokens: one for each CJK character, four for three other words."""
    cjk = F.size(F.regexp_extract_all(text, F.lit(CJK), F.lit(0)))
    words = F.size(F.regexp_extract_all(F.regexp_replace(text, CJK, " "), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return (cjk + F.floor(words * 4 / 3)).cast("long")


def shortened(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def png_size(data: Column) -> Column:
    """(width, height) from a PNG header, or null."""
    number = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("int")
    png = F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A"
    return F.when(png, F.struct(number(17).alias("width"), number(21).alias("height")))
