"""Formula text as columns: tokens, canonical forms, predicates, references. All in built-in expressions.

Every rule works on the tokens of one grammar; what stands inside a text is never taken for anything else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .refs import body_of, let, parse_ref, quote_sheet, ref_to_r1c1, sheet_of

_TEXT = r'"(?:[^"]|"")*"'
_SHEET = r"(?:'(?:[^']|'')*'|[A-Za-z_][\w.]*(?::[A-Za-z_][\w.]*)?)!"
_CELL = r"\$?[A-Za-z]{1,3}\$?[0-9]{1,9}"
_AREA = rf"(?:{_CELL}(?:\s*:\s*{_CELL})?|\$?[A-Za-z]{{1,3}}:\$?[A-Za-z]{{1,3}}|\$?[0-9]{{1,9}}:\$?[0-9]{{1,9}})(?![\w.\[]|\s*\()"
_BOOK = r"'(?:[^'\[\]]*[\\/])?\[[^\]]+\](?:[^']|'')*'!|\[[^\]]+\][A-Za-z_0-9][\w.]*!"
#: Areas of this workbook, with a sheet or without; the name or number before one would make it part of something else.
_PLACE = rf"(?<![\w.\])$#]){_SHEET}{_AREA}|(?<![\w.\])$]){_AREA}"
#: Tokens of a formula, longest kind first: text, references into other books, areas, names of sheets, structured references, names (functions with their parenthesis), numbers, errors, operators.
TOKEN = "|".join(
    [
        _TEXT,
        rf"(?:{_BOOK}){_CELL}(?::{_CELL})?",
        _PLACE,
        rf"{_SHEET}[A-Za-z_\\][\w.]*",
        r"[A-Za-z_\\][\w.]*\[(?:[^\[\]]|\[[^\]]*\])*\]",
        r"[A-Za-z_\\][\w.?]*(?:\s*\()?",
        r"[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?|\.[0-9]+",
        r"#[A-Z0-9/]+[!?]?",
        r"<>|<=|>=",
        r"\s+",
        r".",
    ]
)
#: Functions whose value changes from one calculation to the next.
VOLATILE = "NOW|RAND|RANDARRAY|RANDBETWEEN|TODAY"
#: Functions that turn an error into a value.
GUARDS = "IFERROR|IFNA|ISERR|ISERROR|ISNA"
#: Prefixes that files put before the names of newer functions and of names that a formula binds.
_NEWER = r"(?i)^(?:_xlfn\.|_xlws\.|_xlpm\.)+"


def tokens(formula: Column) -> Column:
    """The tokens of a formula without its equals sign."""
    return F.regexp_extract_all(F.regexp_replace(formula, "^=", ""), F.lit(f"(?s){TOKEN}"), F.lit(0))


def is_area(token: Column) -> Column:
    """True for a token that is an A1 reference, not a name, a function or a text."""
    return token.rlike(rf"^(?:{_SHEET})?{_AREA}$") & parse_ref(body_of(token)).isNotNull()


def rewritten(formula: Column, use) -> Column:
    """The formula without its equals sign, `use` applied to each area; all between the areas stays as it is.

    The formula is cut by one match: a mark is put around every area, after texts and other tokens that
    may look like one are passed over, and only marked parts are looked at.
    """
    skip = rf"{_TEXT}|(?:{_BOOK}){_CELL}(?::{_CELL})?|[A-Za-z_\\][\w.]*\[(?:[^\[\]]|\[[^\]]*\])*\]|[A-Za-z_\\][\w.?]*\s*\("
    marked = F.regexp_replace(F.regexp_replace(formula, "^=", ""), rf"(?s)({skip})|({_PLACE})", "$1\x01$2\x01")
    parts = lambda text: F.split(text, "\x01")
    # Odd parts are areas, or empty where something was passed over.
    return let(parts(marked), lambda p: F.array_join(F.transform(p, lambda t, i: F.when((i % 2 == 1) & (t != ""), use(t)).otherwise(t)), ""))


def canonical_r1c1(formula: Column, row: Column, col: Column) -> Column:
    """The formula with every A1 reference made relative to its cell: copies of one formula get one text."""
    return rewritten(formula, lambda t: F.coalesce(ref_to_r1c1(t, row, col), t))


def structural_key(formula: Column) -> Column:
    """A weaker key: cells become @, white space one space, letters small."""
    cells = lambda t: F.when(parse_ref(t).isNull(), t).when(body_of(t).rlike("[A-Za-z][$]?[0-9]"), F.when(t.contains(":"), "@:@").otherwise("@")).otherwise(t)
    return F.lower(F.trim(F.regexp_replace(F.concat(F.when(formula.startswith("="), "=").otherwise(""), rewritten(formula, cells)), r"\s+", " ")))


def qualified(formula: Column, sheet: Column) -> Column:
    """The formula with `sheet` before every reference that names none."""
    own = lambda t: F.when(sheet_of(t).isNull() & parse_ref(t).isNotNull(), F.concat(quote_sheet(sheet), F.lit("!"), t)).otherwise(t)
    return F.concat(F.lit("="), rewritten(formula, own))


def called(all_: Column) -> Column:
    """Names of the functions among the tokens, in capitals, without the prefixes of newer ones."""
    functions = F.filter(all_, lambda t: t.rlike(r"^[A-Za-z_\\][\w.?]*\s*\($"))
    return F.transform(functions, lambda t: F.upper(F.regexp_replace(F.regexp_replace(t, r"\s*\($", ""), _NEWER, "")))


def _calls_any(formula: Column, names: str) -> Column:
    """Whether a function of `names` is called; tokens are taken only of a formula that has its letters somewhere."""
    wanted = F.array(*[F.lit(n) for n in names.split("|")])
    return formula.rlike(f"(?i)(?:{names})") & F.arrays_overlap(called(tokens(formula)), wanted)


def is_volatile(formula: Column) -> Column:
    return _calls_any(formula, VOLATILE)


def is_guarded(formula: Column) -> Column:
    return _calls_any(formula, GUARDS)


def _of_books(token: Column) -> Column:
    """True for a token with brackets: a reference into another book, or a structured one."""
    return token.contains("[") & ~token.startswith('"')


def _of_sheets(all_: Column) -> Column:
    """Tokens that name a sheet of this workbook."""
    return F.filter(all_, lambda t: t.contains("!") & ~t.rlike('^["#]') & ~_of_books(t))


def named_sheets(formula: Column) -> Column:
    """Sheets that a formula names; #REF! names none."""
    return F.array_distinct(F.transform(_of_sheets(tokens(formula)), sheet_of))


def is_unresolvable(formula: Column, sheets: Column) -> Column:
    """Not guarded, and with a bracketed or 3-D reference or a sheet that isn't in the array `sheets`."""
    test = lambda all_: F.exists(all_, lambda t: _of_books(t) | (t == "[")) | F.exists(_of_sheets(all_), lambda t: sheet_of(t).contains(":") | ~F.array_contains(sheets, sheet_of(t)))
    return ~is_guarded(formula) & formula.rlike(r"[\[!]") & let(tokens(formula), test)


def bound(all_: Column) -> Column:
    """Names, in capitals, that LET and LAMBDA bind among tokens without white space.

    A walk over the tokens keeps a frame (function, argument) for each open parenthesis: names at even
    arguments of LET, and any argument of LAMBDA, that a comma follows.
    """
    frame = "struct<f: string, n: int>"
    empty = F.struct(F.array().cast(f"array<{frame}>").alias("open"), F.array().cast("array<string>").alias("names"))
    opens = lambda f: F.struct(F.when(f.isin("LET", "LAMBDA"), f).otherwise("").alias("f"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        t, stack = x["t"], s["open"]
        top = F.try_element_at(stack, F.size(stack))
        rest = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        name = F.upper(F.regexp_replace(F.regexp_replace(t, r"\s*\($", ""), _NEWER, ""))
        binds = (x["next"] == ",") & t.rlike(r"^[A-Za-z_\\][\w.]*$") & ((top["f"] == "LAMBDA") | ((top["f"] == "LET") & (top["n"] % 2 == 0)))
        moved = F.when(t.endswith("("), F.concat(stack, F.array(opens(name)))).when(t == ")", rest).when((t == ",") & (F.size(stack) > 0), F.concat(rest, F.array(F.struct(top["f"].alias("f"), (top["n"] + 1).cast("int").alias("n"))))).otherwise(stack)
        return F.struct(moved.alias("open"), F.when(F.coalesce(binds, F.lit(False)), F.concat(s["names"], F.array(name))).otherwise(s["names"]).alias("names"))

    paired = F.transform(all_, lambda t, i: F.struct(t.alias("t"), F.coalesce(F.try_element_at(all_, i + 2), F.lit("")).alias("next")))
    return F.aggregate(paired, empty, step)["names"]


def references(formula: Column) -> Column:
    """Distinct areas and names that a formula reads, in order; functions, texts and LET or LAMBDA names aren't among them."""

    def read(all_: Column) -> Column:
        names = F.when(formula.rlike(r"(?i)(?:LET|LAMBDA)\s*\("), bound(all_)).otherwise(F.array().cast("array<string>"))
        operand = lambda t: (t.rlike(r"^['A-Za-z_\\\[$]") | t.rlike(r"^[0-9]+:[0-9]+$")) & ~t.endswith("(") & ~t.rlike(r"(?i)^(?:TRUE|FALSE|\[)$")
        return F.array_distinct(F.filter(all_, lambda t: operand(t) & ~F.array_contains(names, F.upper(F.regexp_replace(t, _NEWER, "")))))

    return let(F.filter(tokens(formula), lambda t: ~t.rlike(r"^\s+$")), read)


def external_refs(formula: Column) -> Column:
    """Array of structs (dir, book, sheet, cell) for references into other workbooks: what stands before, in and after the brackets, and after the last exclamation mark."""

    def parts(t: Column) -> Column:
        cell = F.substring_index(t, "!", -1)
        head = F.left(t, F.length(t) - F.length(cell) - 1)
        head = F.when(head.startswith("'"), F.replace(F.substring(head, F.lit(2), F.length(head) - 2), F.lit("''"), F.lit("'"))).otherwise(head)
        return let(F.struct(head.alias("head"), cell.alias("cell")), lambda x: F.struct(F.substring_index(x["head"], "[", 1).alias("dir"), F.substring_index(F.substring_index(x["head"], "]", 1), "[", -1).alias("book"), F.substring_index(x["head"], "]", -1).alias("sheet"), x["cell"].alias("cell")))

    return F.transform(F.filter(tokens(formula), lambda t: _of_books(t) & t.contains("!")), parts)


def guard_fallback(formula: Column) -> Column:
    """The second argument of a top-level IFERROR or IFNA whose arguments hold no comma of their own, or null.

    Found by the depth of parentheses at each token: the guard opens the formula, its end closes it, and one comma lies at depth 1.
    """

    def second(all_: Column) -> Column:
        step = lambda s, t: F.when(t.endswith("("), s + 1).when(t == ")", s - 1).otherwise(s)
        depth = F.transform(all_, lambda t, i: F.aggregate(F.slice(all_, 1, i + 1), F.lit(0), step))
        at = F.filter(F.transform(all_, lambda t, i: F.when((t == ",") & (depth[i] == 1), i)), lambda i: i.isNotNull())
        whole = F.element_at(all_, 1).rlike(rf"(?i)^(?:_xlfn\.)?(?:IFERROR|IFNA)\s*\($") & (F.size(at) == 1) & (F.array_position(depth, F.lit(0)) == F.size(all_))
        return F.when(whole, F.trim(F.array_join(F.slice(all_, at[0] + 2, F.size(all_) - at[0] - 2), "")))

    guard = formula.rlike(r"(?i)^=\s*(?:_xlfn\.)?(?:IFERROR|IFNA)\s*\(")
    return F.when(guard, let(tokens(F.trim(F.regexp_replace(formula, r"^=\s*", ""))), second))
