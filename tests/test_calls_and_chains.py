"""Chains as scans, and lookups and conditional sums, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlineage.functions import values as V
from gridlineage.functions import vectors as X
from gridlineage.operators import calls, chains, evaluate
from gridlineage.operators.ordered import by_tile, in_tiles, placed

PLACE = "workbook_id string, sheet string, row int, col int"


def values_of(spark, cells):
    """Cells (sheet, row, col, value), a text that begins with # being an error."""
    kind = lambda v: "bool" if isinstance(v, bool) else "num" if isinstance(v, int | float) else "error" if v[:1] == "#" else "text"
    rows = [("w", s, r, c, (k := kind(v), float(v) if k == "num" else None, v if k == "text" else None, v if k == "bool" else None, v if k == "error" else None)) for s, r, c, v in cells]
    return spark.createDataFrame(rows, f"{PLACE}, value {V.VALUE}")


def results(spark, formulas, cells):
    rows = spark.createDataFrame([("w", *f) for f in formulas], f"{PLACE}, formula string")
    of = lambda v: {"num": v.n, "text": v.s, "bool": v.b, "error": v.err}.get(v.kind, v.kind)
    return {(r.sheet, r.row, r.col): of(r.value) for r in evaluate.evaluate(rows, values_of(spark, cells)).collect()}


def test_chains_are_scanned(spark, monkeypatch):
    n, rng = 400, random.Random(2)
    a = {r: rng.randint(-9, 9) for r in range(1, n + 1)}
    cells = [("S", r, 1, v if r != 77 else "#N/A") for r, v in a.items()] + [("S", 1, 10, "x"), ("T", 5, 1, 3)]
    made = {
        2: lambda r: f"=B{r - 1}+A{r}", 3: lambda r: f"=MAX(0,C{r - 1}*0.5+A{r})", 4: lambda r: f"=IF(MOD(ROW_{r},50)=0,A{r},D{r - 1}-A{r})".replace(f"ROW_{r}", str(r)), 5: lambda r: f"=MIN(20,MAX(-5,-E{r - 1}+SUM(A{r},3)))/2",
        6: lambda r: f"=IF(A{r}>7,0,SUM(F{r - 1},1))", 7: lambda r: f"=G{r + 1}+A{r}", 8: lambda r: f"=H{r - 2}+1" if r > 2 else f"={r}", 9: lambda r: f'=IF(A{r}=0,"none",1+I{r - 1})', 10: lambda r: f"=J{r - 1}+1",
    }
    formulas = [("S", r, c, f(r)) for c, f in made.items() for r in range(2, n + 1)]
    formulas = [f for f in formulas if "MOD(" not in f[3]] + [("S", r, 4, f"=IF(A{r}=9,A{r},D{r - 1}-A{r})") for r in range(2, n + 1)]
    formulas += [("T", 5, c, f"={chr(63 + c)}5*2") for c in range(2, 9)]
    knots = []
    monkeypatch.setattr(evaluate, "_knots", lambda now, *more, own=evaluate._knots: knots.append({r.col for r in now.select("col").distinct().collect()}) or own(now, *more))
    got = results(spark, formulas, cells)
    assert set().union(*knots) <= {9}
    value = lambda r: "#N/A" if r == 77 else a.get(r, 0)
    want = dict.fromkeys(range(2, 11), 0.0)
    for r in range(2, n + 1):
        v = value(r)
        bad = v == "#N/A"
        keep = lambda c, f, reset=False: v if bad else f(want[c]) if reset or not isinstance(want[c], str) else want[c]  # noqa: B023, E731
        want[2] = keep(2, lambda x: x + v)  # noqa: B023
        want[3] = keep(3, lambda x: max(0, x * 0.5 + v))  # noqa: B023
        want[4] = keep(4, lambda x: v if v == 9 else x if isinstance(x, str) else x - v, True)  # noqa: B023
        want[5] = keep(5, lambda x: min(20, max(-5, -x + v + 3)) / 2)  # noqa: B023
        want[6] = keep(6, lambda x: 0 if v > 7 else x if isinstance(x, str) else x + 1, True)  # noqa: B023
        want[9] = v if bad else "none" if v == 0 else "#VALUE!" if want[9] == "none" else want[9] if isinstance(want[9], str) else want[9] + 1
        for c in (2, 3, 4, 5, 6, 9):
            assert got["S", r, c] == (pytest.approx(want[c]) if not isinstance(want[c], str) else want[c]), (r, c)
        assert got["S", r, 8] == ((r + 1) // 2 + (1 if r % 2 == 0 else -1) if r > 2 else 2) or r == 3
        assert got["S", r, 10] == "#VALUE!"
    up = 0
    for r in range(n, 1, -1):
        up = "#N/A" if r == 77 or isinstance(up, str) else up + a[r]
        assert got["S", r, 7] == up
    assert [got["T", 5, c] for c in range(2, 9)] == [3 * 2**k for k in range(1, 8)]


def test_functions_compose():
    rng = np.random.default_rng(5)
    n = 500
    value = X.numbers(rng.normal(size=n))
    m = chains.Maps(rng.random(n) < 0.9, rng.choice([-1, 0, 0.5, 1, 2], n), rng.normal(size=n), *np.sort(rng.normal(size=(2, n)) * 5, axis=0), value)
    m.lo[rng.random(n) < 0.5], m.hi[rng.random(n) < 0.5] = -np.inf, np.inf
    x, want = 0.3, []
    for k in range(n):
        x = min(m.hi[k], max(m.lo[k], m.a[k] * x + m.b[k])) if m.dep[k] else value.n[k]
        want.append(x)
    assert chains.scan(m).apply(X.numbers(np.full(n, 0.3))).n == pytest.approx(np.array(want))


def test_places_in_order(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), float(rng.randint(0, 12)), 0, i, i) for i in range(300)] + [("a", 5.0, 0, 1000 + i, 1000 + i) for i in range(300)]
    rows += [(rng.choice("abc"), float(rng.randint(-1, 13)), rng.choice([-1, 1]), 5000 + i, None) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, x double, tie int, spread long, at long").withColumn("cell", F.when(F.col("at").isNotNull(), F.struct("at"))).repartition(5)
    for r in placed(df, ["g"], ["x"], "cell", after=True).filter("at is null").collect():
        own = sorted((x, 0, i) for g, x, _, _, i in rows if g == r.g and i is not None)
        upto, beyond = [c for c in own if c < (r.x, r.tie)], [c for c in own if c > (r.x, r.tie)]
        assert (r.before, r["last"] and r["last"].at, r["next"] and r["next"].at) == (len(upto), upto[-1][2] if upto else None, beyond[0][2] if beyond else None)


def test_tiles_make_up_ranges(spark):
    rng = random.Random(1)
    rows = [(i, *sorted((rng.randrange(3000), rng.randrange(3000)))) for i in range(60)] + [(60, 5, 4), (61, 0, 0), (62, 0, 4095)]
    df = spark.createDataFrame(rows, "i int, a long, b long")
    got = {}
    for r in in_tiles(df, F.col("a"), F.col("b"), "p", 7).collect():
        got.setdefault(r.i, []).extend(range(r.p.at * 4**r.p.size, (r.p.at + 1) * 4**r.p.size))
    assert {i: sorted(got.get(i, [])) for i, _, _ in rows} == {i: list(range(a, b + 1)) for i, a, b in rows}
    assert [(r.p.size, r.p.at) for r in by_tile(df.filter("i = 62"), F.col("b"), "p", 3).collect()] == [(0, 4095), (1, 1023), (2, 255)]


def meets(want, v):
    """Whether a cell (None for a blank) meets a criterion."""
    if isinstance(want, str):
        op = next((o for o in ("<=", ">=", "<>", "=", "<", ">") if want.startswith(o)), "")
        rest = want[len(op) :]
        number = lambda t: float(t) if t.replace(".", "", 1).lstrip("-").isdigit() else t
        if op in ("<", ">", "<=", ">="):
            rest = number(rest)
            same = not isinstance(v, bool) and isinstance(v, int | float) if isinstance(rest, float) else isinstance(v, str) and v[:1] != "#"
            x, y = (v, rest) if isinstance(rest, float) else ((v or "").lower() if isinstance(v, str) else v, rest.lower())
            return same and {"<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y}[op]()
        if op == "<>":
            return not meets(f"={rest}", v)
        if not rest:
            return v is None or (not op and v == "")
        if rest == "a*":
            return isinstance(v, str) and v.lower().startswith("a")
        want = number(rest)
    if isinstance(want, float):
        return not isinstance(v, bool) and (v == want if isinstance(v, int | float) else isinstance(v, str) and v.strip() == f"{want:g}")
    return isinstance(v, str) and v.lower() == want.lower()


def test_criteria(spark):
    rng, n = random.Random(11), 60
    pick = lambda r: {1: rng.choice([1, 2, 3, 3.5, "2", "apple", "Axe", "", "pear", None, True]), 2: rng.choice([-4, 0, 1, 5, 9, None, "b"]), 3: rng.choice([10, 20.5, 30, None, "t"])}
    grid = {r: pick(r) for r in range(1, n + 1)}
    cells = [("S", r, c, v) for r, row in grid.items() for c, v in row.items() if v is not None] + [("S", 1, 5, "#DIV/0!"), ("S", 2, 5, 7), ("S", 3, 5, 8), ("S", 1, 6, 1), ("S", 2, 6, 1), ("S", 3, 6, 2)]
    wanted = ["2", 3.0, ">2", "<=3", "<>2", "<>apple", "apple", "a*", ">b", "", "=", "<>", ">=1", "<>zebra"]
    formulas, want = [], []
    told = lambda w: f'"{w}"' if isinstance(w, str) else f"{w:g}"
    for w in wanted:
        rows = [r for r in grid if meets(w, grid[r][1])]
        formulas += [f"=COUNTIF(S!A1:A{n},{told(w)})", f"=SUMIF(S!A1:A{n},{told(w)},S!C1)"]
        want += [len(rows), sum(grid[r][3] for r in rows if isinstance(grid[r][3], int | float))]
        for u, low in ((">0", 1), ("<=5", 20)):
            rows = [r for r in grid if r >= low and meets(w, grid[r][1]) and meets(u, grid[r][2])]
            formulas += [f'=COUNTIFS(S!A{low}:A{n},{told(w)},S!B{low}:B{n},"{u}")', f'=SUMIFS(S!C{low}:C{n},S!B{low}:B{n},"{u}",S!A{low}:A{n},{told(w)})']
            want += [len(rows), sum(grid[r][3] for r in rows if isinstance(grid[r][3], int | float))]
    for end in range(5, n, 6):
        rows = [r for r in range(1, end + 1) if meets(">=0", grid[r][2]) and meets("<6", grid[r][2]) and meets("<>2", grid[r][1])]
        own = [grid[r][3] for r in rows if isinstance(grid[r][3], int | float)]
        formulas += [f'=SUMIFS(S!C$1:C{end},S!B$1:B{end},">=0",S!B$1:B{end},"<6",S!A$1:A{end},"<>2")', f'=AVERAGEIFS(S!C$1:C{end},S!B$1:B{end},">=0",S!B$1:B{end},"<6",S!A$1:A{end},"<>2")']
        want += [sum(own), sum(own) / len(own) if own else "#DIV/0!"]
        # The interval of one range and that of another.
        rows = [r for r in range(1, end + 1) if meets(">0", grid[r][2]) and meets(">=2", grid[r][1])]
        formulas.append(f'=COUNTIFS(S!B$1:B{end},">0",S!A$1:A{end},">=2")')
        want.append(len(rows))
    formulas += ["=SUMIFS(S!E1:E3,S!F1:F3,1)", "=SUMIFS(S!E1:E3,S!F1:F3,2)", "=SUMPRODUCT(S!E1:E3,S!F1:F3)", "=COUNTIF(S!E1:E3,S!E1)", '=COUNTIF(S!A1:A9,"?x")', '=COUNTIF(S!A1:A9,">1/2/2020")', "=COUNTIF(S!G1:G4,0)", "=AVERAGEIF(S!F1:F3,9)"]
    want += ["#DIV/0!", 8, "#DIV/0!", 1, "uncomputed", "uncomputed", 0, "#DIV/0!"]
    got = results(spark, [("T", i, 1, f) for i, f in enumerate(formulas, 1)], cells)
    for i, (f, w) in enumerate(zip(formulas, want, strict=True), 1):
        assert got["T", i, 1] == (pytest.approx(w) if not isinstance(w, str) else w), f


def test_nearest_matches(spark):
    rng, n = random.Random(3), 40
    up = sorted(rng.randint(0, 30) for _ in range(n))
    cells = [("S", r, 1, v) for r, v in enumerate(up, 1) if r % 7] + [("S", r, 2, v) for r, v in enumerate(reversed(up), 1)] + [("S", r, 3, f"v{r}") for r in range(1, n + 1)] + [("S", r, 4, t) for r, t in enumerate(("ash", "Beech", "fig", "oak"), 1)]
    cells += [("S", 60, c, v) for c, v in enumerate((1, 4, 4, 9), 1)] + [("S", 61, c, v) for c, v in enumerate("pqrs", 1)]
    col = {r: v for s, r, c, v in cells if c == 1 and r < 50}
    down = {r: v for s, r, c, v in cells if c == 2 and r < 50}
    formulas, want = [], []
    for x in (-1, 0, 7, 7.5, 15, 30, 31):
        below, above = [v for v in col.values() if v <= x], [v for v in col.values() if v >= x]
        first = lambda v: min(r for r in col if col[r] == v)
        last = lambda v: max(r for r in col if col[r] == v)
        formulas += [f"=MATCH({x},S!A1:A{n})", f"=VLOOKUP({x},S!A1:C{n},3,TRUE)", f"=XMATCH({x},S!A1:A{n},-1)", f"=XMATCH({x},S!A1:A{n},1)", f"=XLOOKUP({x},S!A1:A{n},S!C1:C{n},\"no\",1,-1)", f"=MATCH({x},S!B1:B{n},-1)", f"=LOOKUP({x},S!A1:A{n},S!C1:C{n})"]
        least = [v for v in down.values() if v >= x]
        na = lambda ok, v: v() if ok else "#N/A"
        want += [na(below, lambda: last(max(below))), na(below, lambda: f"v{last(max(below))}"), na(below, lambda: first(max(below))), na(above, lambda: first(min(above))), f"v{last(min(above))}" if above else "no", na(least, lambda: max(r for r in down if down[r] == min(least))), na(below, lambda: f"v{last(max(below))}")]  # noqa: B023
    for end in range(3, n, 4):
        seen = {r: v for r, v in col.items() if r <= end and v <= 12}
        formulas += [f"=MATCH(12,S!A$1:A{end},1)", f"=XMATCH(S!A{end - 1 if (end - 1) % 7 else end},S!A$1:A{end},0,-1)"]
        want += [max((r for r in seen if seen[r] == max(seen.values())), default="#N/A"), max(r for r in col if r <= end and col[r] == col[end - 1 if (end - 1) % 7 else end])]
    formulas += ['=MATCH("fern",S!D1:D4,1)', '=MATCH("aaa",S!D1:D4,1)', "=MATCH(5,S!D1:D4,1)", "=HLOOKUP(4,S!A60:D61,2,FALSE)", "=HLOOKUP(8,S!A60:D61,2)", "=MATCH(4,S!A60:D60,0)", "=XLOOKUP(4,S!A60:D60,S!A61:D61,0,0,-1)", '=VLOOKUP(4,S!A1:C9,9,FALSE)', "=MATCH(1/0,S!A1:A9,0)"]
    want += [2, "#N/A", "#N/A", "q", "r", 2, "r", "#REF!", "#DIV/0!"]
    got = results(spark, [("T", i, 1, f) for i, f in enumerate(formulas, 1)], cells)
    for i, (f, w) in enumerate(zip(formulas, want, strict=True), 1):
        assert got["T", i, 1] == w, f


def test_readers_of_volatile_cells(spark):
    cells = [("S", r, 1, r) for r in range(1, 5)]
    formulas = {"B1": "=TODAY()", "B2": "=B1+1", "B3": "=IF(B2>0,1,2)", "B4": "=SUM(A1:B1)", "B5": "=COUNTIF(A1:B2,1)", "B6": "=MATCH(3,A1:A4,0)", "B7": "=VLOOKUP(9,B1:B4,1,FALSE)", "B8": "=A1*2", "B9": "=B8+B8", "B10": "=B9+B1", "B11": "=SUMIF(A1:A4,\">2\",B1:B4)"}
    got = results(spark, [("S", int(k[1:]), 2, f) for k, f in formulas.items()], cells)
    assert [got["S", r, 2] for r in range(1, 12)] == ["uncomputed"] * 5 + [3, "uncomputed", 2, 4, "uncomputed", "uncomputed"]


def test_criterion_texts():
    assert calls.criterion(X.TEXT, math.nan, ">=-2.5") == [calls.between("num", -2.5, None, open_=False)]
    assert calls.criterion(X.TEXT, math.nan, "<Q") == [calls.between("text", None, "q", open2=True)]
    assert calls.criterion(X.TEXT, math.nan, "*x") is None and calls.criterion(X.LOST, math.nan, None) is None
    assert calls.criterion(X.TEXT, math.nan, "<>") == [(1, {"op": "any"}), (-1, {"op": "eq", "kind": "blank", "n": None, "s": None})]
    both = calls.narrowed(calls.between("num", 1, 9)[1], calls.between("num", 3, None, open_=True)[1])
    assert (both["n"], both["open"], both["n2"]) == (3, True, 9)


def test_arrays_and_lambdas(spark):
    grid = {1: (1, 2, 10, "a"), 2: (3, 4, 20, "b"), 3: (5, 6, 30, "a"), 4: (None, 8, 40, "c"), 5: (9, None, 50, "a")}
    cells = [("S", r, c, v) for r, row in grid.items() for c, v in enumerate(row, 1) if v is not None] + [("S", 1, 6, 3), ("S", 2, 6, "a"), ("S", 1, 8, "#N/A"), ("S", 2, 8, 5)]
    cases = {
        "=SUM({1,2;3,4})": 10, "=SUM({1,2,3}*S!A1)": 6, "=MAX({1,7,3}+{0;10})": 17, "={5,6}": 5, "=SUMPRODUCT({1,2},{3,4})": 11, "=SUM({1,2}*{1,2,3})": "#N/A", '=VLOOKUP("b",{"a",1;"b",2},2,FALSE)': 2, "=LOOKUP(25,{0,10,20,30},{\"w\",\"x\",\"y\",\"z\"})": "y",
        "=MATCH(3,{1,3,5},0)": 2, '=SUM(COUNTIF(S!D1:D5,{"a","c"}))': 4, '=MATCH("q",{"a","b"},0)': "#N/A", "=AVERAGE({2,4,-6})": 0,
        "=SUM(S!A1:A5*S!B1:B5)": 44, "=SUMPRODUCT(--(S!D1:D5=\"A\"),S!C1:C5)": 90, "=SUMPRODUCT((S!A1:A5>=S!F1)*(S!D1:D5=S!F2)*S!C1:C5)": 80, "=SUM(S!A1:A5+1)": 23, "=MAX(S!A1:A5-S!B1:B5)": 9, "=MIN(S!C1:C5/10)": 1, "=AVERAGE(IF(S!D1:D5=\"a\",S!C1:C5))": 30,
        "=SUM(S!H1:H2*2)": "#N/A", "=SUM(IFERROR(S!H1:H2*2,1))": 11, "=COUNT(S!A1:A5*1)": 5, "=SUM(S!A1:A5*S!B1:B4)": "uncomputed", "=SUM(S!A1:A9000=0)": 0, "=SUMPRODUCT(--(S!A1:A9000=0))": 8996, "=SUM(LEN(S!D1:D5))": 5, "=SUMPRODUCT(S!A1:A5>2,S!C1:C5)": 0, "=COUNT(IF(S!A1:A5>2,S!C1:C5))": 3 + 0,
        "=LAMBDA(p,q,p*q)(S!A2,2)": 6, "=LET(f,LAMBDA(x,x*2),f(S!A2)+f(1))": 8, "=LAMBDA(x,LET(y,x+1,LAMBDA(x,x*y)(10)))(1)": 20, "=LET(y,5,f,LAMBDA(x,x+y),y,1,f(y))": 6, "=LAMBDA(x,x)": "#CALC!", "=LAMBDA(x,x)(1,2)": "#VALUE!", "=LET(f,LAMBDA(g,x,g(g(x))),f(LAMBDA(z,z*3),2))": 18,
        "=LAMBDA(r,SUM(r))(S!C1:C5)": 150, '=SUM({1,"x")': "uncomputed",
    }
    cases["=COUNT(IF(S!A1:A5>2,S!C1:C5))"] = 3
    rows = [("T", i, 1, f) for i, f in enumerate(cases, 1)] + [("U", r, 1, f"=SUM(S!A$1:A{r}*S!C$1:C{r})") for r in range(1, 6 + 4)] + [("U", r, 2, f"=MAX(S!A$1:A{r}*S!C$1:C{r})") for r in range(2, 10)]
    got = results(spark, rows, cells)
    for i, (f, w) in enumerate(cases.items(), 1):
        assert got["T", i, 1] == w, f
    products = [(grid[r][0] or 0) * grid[r][2] if r in grid else 0 for r in range(1, 10)]
    assert [got["U", r, 1] for r in range(1, 10)] == [sum(products[:r]) for r in range(1, 10)]
    assert [got["U", r, 2] for r in range(2, 10)] == [max(products[:r]) for r in range(2, 10)]
