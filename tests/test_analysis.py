"""The whole analysis on workbooks made here, and queries against DuckDB."""

import base64
import io
import json
import zipfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridlineage import analyze, cli
from gridlineage.functions import values as V
from gridlineage.functions import vectors
from gridlineage.operators import code, context, dossiers, evaluate, graph
from gridlineage.sinks.export import graph_json, iframe, pages
from gridlineage.sources import workbooks

MAIN, REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(path, sheets, names="", more=(), rels="", head=""):
    with zipfile.ZipFile(path, "w") as z:
        for part, text in more:
            z.writestr(part, text)
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}">{head}<sheets>{listed}</sheets><definedNames>{names}</definedNames></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + rels + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')


PLOTS = 60


@pytest.fixture(scope="module")
def lineage(spark, tmp_path_factory):
    """A garden: plots with length and width, their area as a shared formula, and a report that reads areas and a named price."""
    folder = tmp_path_factory.mktemp("books")
    rows = []
    for r in range(4, 4 + PLOTS):
        area = '<c r="E4"><f t="shared" ref="E4:E63" si="3">C4*D4</f><v>5</v></c>' if r == 4 else f'<c r="E{r}"><f t="shared" si="3"/></c>'
        rows.append(f'<row><c r="C{r}"><v>{2 + r % 5}</v></c><c r="D{r}"><v>{r / 4}</v></c>{area}</row>')
    report = "".join(f"<row>{c}</row>" for c in ('<c r="A2"><f>MAX(Plots!E4:E63)</f></c>', '<c r="A3"><f>COUNT(Plots!E4:E63)*Price</f></c>', '<c r="A4"><f>IF(A2&gt;A3,"wide","narrow")&amp;"!"</f></c>'))
    book(folder / "garden.xlsx", {"Plots": "".join(rows), "Report": report, "Prices": '<row><c r="F9"><v>1.5</v></c></row>'}, "<definedName name='Price'>Prices!$F$9</definedName>")
    (folder / "broken.xlsx").write_bytes(b"no workbook")
    return analyze(spark, str(folder))


def test_nodes_and_edges(lineage):
    nodes = {r.id: r for r in lineage.nodes.collect()}
    plots, inputs = f"g:Plots!E4#{PLOTS}", ["i:Plots!C4:C63", "i:Plots!D4:D63"]
    assert set(nodes) == {plots, *inputs, "c:Report!A2", "c:Report!A3", "c:Report!A4", "i:Prices!F9", "n:Price"}
    edges = {(r.src, r.dst, r.kind) for r in lineage.edges.collect()}
    want = {(i, plots, "dep") for i in inputs} | {(plots, "c:Report!A2", "dep"), (plots, "c:Report!A3", "dep"), ("c:Report!A2", "c:Report!A4", "dep"), ("c:Report!A3", "c:Report!A4", "dep")}
    assert edges == want | {("i:Prices!F9", "n:Price", "name"), ("n:Price", "c:Report!A3", "name")}
    assert (nodes["c:Report!A2"].value.n, nodes["c:Report!A3"].value.n, nodes["c:Report!A4"].value.s) == (88.5, 90, "narrow!")
    assert {r.code for r in lineage.warnings.collect()} == {"values", "file"}


def section(text):
    """A query section as workbooks hold it."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("Formulas/Section1.m", text)
    raw = data.getvalue()
    return f"<DataMashup xmlns='http://schemas.microsoft.com/DataMashup'>{base64.b64encode(bytes(4) + len(raw).to_bytes(4, 'little') + raw).decode()}</DataMashup>"


def linked_books(folder, inside):
    """A workbook that reads another one and has queries, and the other one."""
    link = f'<externalLink xmlns="{MAIN}" xmlns:r="{REL}"><externalBook r:id="rId1"><sheetNames><sheetName val="Rates"/></sheetNames><sheetDataSet><sheetData sheetId="0"><row r="2"><cell r="B2"><v>3</v></cell><cell r="C2" t="str"><v>old</v></cell></row></sheetData></sheetDataSet></externalBook></externalLink>'
    rows = '<row><c r="A1"><f>[1]Rates!B2*2</f><v>5</v></c><c r="B1"><f>IFERROR([1]Rates!C2,"none")</f></c><c r="C1"><f>SUM([1]Rates!B2:B4)</f></c></row>'
    more = [
        ("xl/externalLinks/externalLink1.xml", link),
        ("xl/externalLinks/_rels/externalLink1.xml.rels", '<Relationships><Relationship Id="rId1" Target="file:///C:/far/rates.xlsx" TargetMode="External"/></Relationships>'),
        ("customXml/item1.xml", section('section S; shared Crop = let t = Excel.CurrentWorkbook(){[Name="beds"]}[Content] in t; shared Sum = Crop & Excel.CurrentWorkbook(){[Name="gone"]}[Content];')),
        ("xl/connections.xml", f'<connections xmlns="{MAIN}"><connection id="4" name="x"><dbPr connection="Provider=Microsoft.Mashup.OleDb.1;Data Source=$Workbook$;Location=crop"/></connection></connections>'),
        ("xl/tables/table1.xml", f'<table xmlns="{MAIN}" displayName="Beds" ref="E1:F3"><tableColumns><tableColumn name="a"/><tableColumn name="b"/></tableColumns></table>'),
        ("xl/tables/table2.xml", f'<table xmlns="{MAIN}" displayName="Out" ref="H1:I3"><tableColumns><tableColumn name="a"/></tableColumns></table>'),
        ("xl/tables/_rels/table2.xml.rels", '<Relationships><Relationship Id="rId1" Target="../queryTables/queryTable1.xml"/></Relationships>'),
        ("xl/queryTables/queryTable1.xml", f'<queryTable xmlns="{MAIN}" connectionId="4"/>'),
        ("xl/worksheets/_rels/sheet1.xml.rels", '<Relationships><Relationship Id="rId1" Target="../tables/table1.xml"/><Relationship Id="rId2" Target="../tables/table2.xml"/></Relationships>'),
    ]
    rels = '<Relationship Id="rId9" Target="externalLinks/externalLink1.xml"/>'
    tables = f'<tableParts xmlns="{MAIN}" xmlns:r="{REL}"><tablePart r:id="rId1"/><tablePart r:id="rId2"/></tableParts>'
    head = f'<workbookPr date1904="1"/><externalReferences xmlns:r="{REL}"><externalReference r:id="rId9"/></externalReferences>'
    book(folder / "reader.xlsx", {"Main": rows + "</sheetData>" + tables + "<sheetData>"}, "", more, rels, head)
    inside.mkdir()
    book(inside / "Rates.xlsx", {"Rates": '<row r="2"><c r="B2"><v>10</v></c></row><row r="3"><c r="B3"><v>7</v></c></row>'})


def test_links_and_queries(spark, tmp_path):
    linked_books(tmp_path, tmp_path / "deep")
    for refs_dir, a1, b1, c1, read in ((None, 6, "old", 3, "cached"), (str(tmp_path / "deep"), 20, "old", 17, "read")):
        found = analyze(spark, str(tmp_path / "reader.xlsx"), refs_dir=refs_dir)
        values = {(r.sheet, r.col): r.value for r in found.values.collect()}
        assert (values["Main", 1].n, values["Main", 2].s, values["Main", 3].n) == (a1, b1, c1)
        assert [r.message for r in found.warnings.filter("code = 'links'").collect()] == [f"{read}: rates.xlsx"]
    edges = {(r.src, r.dst) for r in found.edges.filter("kind = 'query'").collect()}
    assert edges == {("i:Main!E1:F3", "q:Crop"), ("q:Crop", "q:Sum"), ("x:gone", "q:Sum"), ("q:Crop", "i:Main!H1:I3")}
    ids = {r.id: r.kind for r in found.nodes.collect()}
    assert {ids[a] for a, _ in edges} | {ids[b] for _, b in edges} == {"input", "query", "opaque"}


def test_context(lineage):
    heads = {r.target.c1: r["head"] for r in lineage.heads().collect() if r.target.sheet == "Plots"}
    assert heads == {3: [str(2 + r % 5) for r in range(4, 9)], 4: ["1", "1.25", "1.5", "1.75", "2"]}
    examples = {r.r1c1: r.examples for r in lineage.examples().collect()}
    assert examples["RC[-2]*RC[-1]"] == ["=C4*D4", "=C5*D5", "=C6*D6"]
    found = {r.id: json.loads(r.dossier) for r in lineage.dossiers().collect() if "garden" in r.workbook_id or r.id}
    whole = found[None]
    assert [s["sheet"] for s in whole["sheets"]] == ["Plots", "Report", "Prices"] and whole["sheets"][0]["formulas"] == PLOTS and whole["patterns"][0]["cells"] == PLOTS
    assert whole["sheets"][0]["preview"][0] == {"row": 4, "texts": ["", "", "6", "1", "5"]} and "c:Report!A2" in found


def test_dossiers_shed_what_is_too_long(spark):
    structure = spark.createDataFrame([("w", "sheet", f"S{k}", k, None, "visible", None) for k in range(3)] + [("w", "comment", "S0", 0, "A1", "note", None)], "workbook_id string, kind string, sheet string, ord int, name string, text string, list array<string>")
    cells = spark.createDataFrame([("w", f"S{k % 4}", r, 1, "x" * 20) for k in range(4) for r in range(1, 11)], "workbook_id string, sheet string, row int, col int, s string").withColumn("value", V.text(F.col("s")))
    formulas = spark.createDataFrame([("w", "S0", r, 2, f"=A{r}") for r in range(1, 5)], "workbook_id string, sheet string, row int, col int, formula string")
    patterns = spark.createDataFrame([("w", "S0", f"R{k}", k, 1, f"=A{k}", 10 - k) for k in range(9)], "workbook_id string, sheet string, r1c1 string, rep_row int, rep_col int, formula string, cells int")
    told = lambda longest: json.loads(context.workbook_dossiers(structure, cells, patterns, formulas, longest=longest).first().dossier)
    size = lambda d: (len(d["sheets"][0].get("preview", [])), len(d["patterns"]), "comments" in d["sheets"][0], [s["sheet"] for s in d["sheets"]])
    every = ["S0", "S1", "S2", "S3"]
    assert sorted(size(told(10**6))[3]) == every
    whole = len(json.dumps(told(10**6)))
    assert size(told(10**6))[:3] == (10, 9, True)
    steps = [(10, 9, True), (4, 9, True), (4, 5, True), (0, 5, False)]
    seen = [size(told(k))[:3] for k in range(whole, 100, -(whole // 8))]
    assert seen == sorted(seen, key=steps.index) and {steps[0], steps[1], steps[3]} <= set(seen)


def test_dates_and_previews(spark):
    from gridlineage.functions.refs import parse_ref

    place = "workbook_id string, sheet string, row int, col int"
    cells = spark.createDataFrame([("old", "S", 1, 1, 61.0, True), ("new", "S", 1, 1, 0.0, True), ("old", "S", 2, 1, 5.0, False)], f"{place}, n double, is_date boolean").withColumn("value", V.number(F.col("n")))
    structure = spark.createDataFrame([("new", "epoch")], "workbook_id string, kind string")
    assert {(r.workbook_id, r.row): r.date and str(r.date) for r in context.dated(cells.select("workbook_id", "sheet", "row", "col", "value"), cells, structure).collect()} == {("old", 1): "1900-03-01", ("new", 1): "1904-01-01", ("old", 2): None}
    reads = spark.createDataFrame([("old", "rect", None, "S!A1"), ("old", "rect", None, "S!A1:B9"), ("old", "name", "Tax", None), ("old", "opaque", "T[a]", None)], "workbook_id string, kind string, ref string, at string").withColumn("target", parse_ref(F.col("at")))
    names = spark.createDataFrame([("old", "TAX", "S!A2")], "workbook_id string, name string, at string").withColumn("targets", F.array(parse_ref(F.col("at"))))
    found = {(r.ref, r.at): r.preview for r in context.shown(reads, cells.select("workbook_id", "sheet", "row", "col", "value"), names).collect()}
    assert found == {(None, "S!A1"): "61", (None, "S!A1:B9"): "S!A1:B9 (18)", ("Tax", None): "S!A2", ("T[a]", None): None}


def test_modules_of_addins(spark):
    streams = spark.createDataFrame([("w", "M", 2, "b"), ("w", "M", 1, "a"), ("w", "N", 1, "c")], "workbook_id string, module string, ord int, code string")
    addins = spark.createDataFrame([("w", "M", "z")], "workbook_id string, module string, code string")
    assert {(r.module, r.code) for r in code.with_addins(code.joined_streams(streams), addins).collect()} == {("M", "a\nb"), ("N", "c"), ("addin:M", "z")}
    called = spark.createDataFrame([("w", "M", "p", "N", "z"), ("w", "M", "p", "M", "a")], "workbook_id string, module string, proc string, callee_module string, callee string")
    assert [r.calls for r in code.call_lists(called).collect()] == [["M.a", "N.z"]]


def test_exports(lineage):
    assert "\\u003c" not in graph_json(lineage).first().graph
    html = pages(lineage).first().html
    assert html.startswith("<!DOCTYPE html>") and "c:Report!A2" in html and "base64" in iframe(html)
    with pytest.raises(ValueError):
        pages(lineage, "xx")
    for row in graph_json(lineage, drawn=True).collect():
        g = json.loads(row.graph)
        assert {p["id"] for p in g.get("places", [])} == {n["id"] for n in g.get("nodes", [])}
        assert {(l["src"], l["dst"]) for l in g.get("lines", [])} == {(e["src"], e["dst"]) for e in g.get("edges", []) if {e["src"], e["dst"]} <= {n["id"] for n in g["nodes"]} and e["src"] != e["dst"]}
    drawn = pages(lineage, drawn=True).first().html
    assert "<svg id=d>" in drawn and "polyline" in drawn and "<svg" not in html


def test_documents(lineage):
    class Writer:
        """A provider that fails on some dossiers and knows the tokens of some others."""

        def generate_with_usage(self, prompt):
            found = json.loads(prompt)
            if found.get("id") == "c:Report!A3":
                raise RuntimeError("busy")
            return f"<{found.get('id', 'book')}>", 7 if "sheets" in found else None, None

    docs = lineage.documents(Writer())
    found = {r.id: r for r in docs.collect() if "garden" in r.workbook_id}
    assert {i: r.doc for i, r in found.items() if r.error is None} == {None: "<book>", "c:Report!A2": "<c:Report!A2>", "c:Report!A4": "<c:Report!A4>", f"g:Plots!E4#{PLOTS}": f"<g:Plots!E4#{PLOTS}>"}
    assert found["c:Report!A3"].error == "RuntimeError: busy" and found[None].tokens_in == 7
    spent = next(r for r in lineage.usage(docs).collect() if "garden" in r.workbook_id)
    assert spent.requests == 4 and spent.estimated and spent.tokens_in > 7 and spent.tokens_out > 0
    graph_ = json.loads(graph_json(lineage, docs).filter("graph like '%Report%'").first().graph)
    assert {n["id"]: n["doc"] for n in graph_["nodes"]}["c:Report!A2"] == "<c:Report!A2>" and {n["doc"] for n in graph_["nodes"] if n["kind"] == "input"} == {""}
    assert all(e["id"].startswith("e") for e in graph_["edges"]) and len({e["id"] for e in graph_["edges"]}) == len(graph_["edges"])
    assert "x.doc" in pages(lineage, docs=docs).first().html
    too_long = dossiers.documented(docs.select("workbook_id", "id", F.col("prompt").alias("dossier")), lambda p: p, node_chars=3).collect()
    assert {r.id for r in too_long if r.error} == {i for i in found if i}


def test_command_line(spark, tmp_path, capsys):
    book(tmp_path / "a.xlsx", {"One": '<row><c r="A1"><f>B1*2</f><v>1</v></c><c r="B1"><v>4</v></c></row>', "Two": "</sheetData><sheetViews><sheetView><pane state='frozen' topLeftCell='B3'/></sheetView></sheetViews><dimension ref='A1:XFD1048576'/><sheetData>"})
    path = str(tmp_path / "a.xlsx")
    assert cli.main(["--dry-run", path]) == 0
    told = capsys.readouterr().out
    assert "17179869184" in told and "true" in told
    assert cli.main(["--json", "-", "-v", "--no-html", "--html", str(tmp_path / "html"), path]) == 0
    out, err = capsys.readouterr()
    assert {n["id"] for n in json.loads(out)["nodes"]} == {"c:One!A1", "i:One!B1"} and "calculated 8, stored 1" in err and not (tmp_path / "html").exists()
    assert cli.main(["--dry-run", str(tmp_path / "none.xlsx")]) == 2
    with pytest.raises(SystemExit):
        cli.main(["--version"])
    kinds = workbooks.structure(workbooks.files(spark, path)).filter("kind = 'frozen'").collect()
    assert [(r.sheet, r.text) for r in kinds] == [("Two", "B3")]


def test_large_queries_are_told(spark, tmp_path, monkeypatch):
    book(tmp_path / "q.xlsx", {"S": ""}, "", [("customXml/item1.xml", section("section S; shared Q = 1;"))])
    assert [r.kind for r in workbooks.structure(workbooks.files(spark, str(tmp_path))).filter("kind in ('query', 'problem')").collect()] == ["query"]
    monkeypatch.setattr(workbooks, "MASHUP", 10)
    with zipfile.ZipFile(tmp_path / "q.xlsx") as z:
        assert [r[0] for r in workbooks._declared(z) if r[0] in ("query", "problem")] == ["problem"]


def test_numbers_as_text(spark):
    numbers = [0.1 + 0.2, 1e20, -1.5e-7, 1 / 3, 123456789012345678.0, 0.0001, -2.5, 1e15, 99999999999999.0, 7.0]
    want = ["0.3", "1E+20", "-1.5E-07", "0.333333333333333", "1.23456789012346E+17", "0.0001", "-2.5", "1E+15", "99999999999999", "7"]
    assert [vectors.plain(n) for n in numbers] == want
    df = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, n double")
    assert [r.t for r in df.select("i", V.as_text(V.number(F.col("n"))).alias("t")).orderBy("i").collect()] == want


CASES = [
    ("=7/(3-3)", "#DIV/0!"), ("=NA()", "#N/A"), ("=SQRT(2-6)", "#NUM!"), ('=3*"cat"', "#VALUE!"), ("=Frobnicate(4)", "#NAME?"), ("=IFERROR(SQRT(0-1),-8)", -8.0), ("=IFERROR(Y8*2,5)", 0.0), ("=-3^2", 9.0), ("=25%*8", 2.0), ("=Nowhere!C3", None),
    ("=SUM(W1:W4 W2:W6)", None), ("=RAND()", None), ('=LEN("green")&"/"&0.5&FALSE', "5/0.5FALSE"), ('="Tea"="tEA"', True), ('=99<"1"', True), ("=ROUND(-7.45,1)", -7.5), ('=CONCATENATE("no",6.0)', "no6"), ("=IF(1-1,3)", False), ("=ISERROR(LEN(4))", False), ("=IFNA(5/0,2)", "#DIV/0!"),
]


def test_formulas(spark):
    rows = [("w", "S", i, 1, f) for i, (f, _) in enumerate(CASES, 1)]
    cells = spark.createDataFrame([("w", "S", 1, 30, 5.0)], "workbook_id string, sheet string, row int, col int, n double").withColumn("value", V.number(F.col("n")))
    out = {r.row: r.value for r in evaluate.evaluate(spark.createDataFrame(rows, "workbook_id string, sheet string, row int, col int, formula string"), cells).collect()}
    for i, (f, want) in enumerate(CASES, 1):
        v = out[i]
        got = {"num": v.n, "text": v.s, "bool": v.b, "error": v.err}.get(v.kind)
        assert got == (pytest.approx(want) if isinstance(want, float) else want), f


def test_knots(spark):
    """Running balances, running sums, patterns that read each other, and real circles."""
    n, rows, cells = 300, [], []
    for r in range(2, n + 2):
        cells.append(("w", "S", r, 1, float(r % 7)))
        rows.append(("w", "S", r, 2, f"=B{r - 1}+A{r}" if r > 2 else "=A2"))
        rows.append(("w", "S", r, 3, f"=SUM(A$2:A{r})"))
        rows.append(("w", "S", r, 4, f'=IF(A{r}=0,0,IF(ISNUMBER(D{r - 1}),D{r - 1},0)+1)'))
        rows.append(("w", "S", r, 5, f"=SUM(E$1:E{r - 1})+1"))
        rows.append(("w", "S", r, 6, f"=G{r - 1}*2" if r > 2 else "=1"))
        rows.append(("w", "S", r, 7, f"=MOD(F{r},5)+1"))
    rows += [("w", "T", 1, 1, "=B1+1"), ("w", "T", 1, 2, "=A1+1"), ("w", "T", 1, 3, "=IFERROR(S!B5,0)"), ("w", "T", 1, 4, "=SUM(S!B2:C9)"), ("w", "T", 1, 5, "=LET(x,S!A3,y,x*2,x+y)")]
    values = spark.createDataFrame(cells, "workbook_id string, sheet string, row int, col int, n double").withColumn("value", V.number(F.col("n")))
    out = {(r.sheet, r.row, r.col): r.value for r in evaluate.evaluate(spark.createDataFrame(rows, "workbook_id string, sheet string, row int, col int, formula string"), values).collect()}
    total, run, f, g, powers = 0, 0, None, None, []
    for r in range(2, n + 2):
        total, run = total + r % 7, run + 1 if r % 7 else 0
        f = 1 if r == 2 else g * 2
        g = f % 5 + 1
        powers.append(sum(powers) + 1)
        assert [out["S", r, c].n for c in range(2, 8)] == [total, total, run, pytest.approx(powers[-1]), f, g], r
    assert [out["T", 1, c].kind for c in (1, 2)] == ["uncomputed"] * 2
    assert [out["T", 1, c].n for c in (3, 4, 5)] == [2 + 3 + 4 + 5, 2 * sum(sum(k % 7 for k in range(2, r + 1)) for r in range(2, 10)), 9]


def test_lookups_in_formulas(spark):
    stock = [("pear", 3.0, "x"), ("fig", 5.0, "y"), ("Plum", 7.0, "x"), ("fig", 9.0, "z"), ("date", None, "x")]
    cells = [("w", "S", r, c, v if c != 2 else None, v if c == 2 else None) for r, row in enumerate(stock, 2) for c, v in enumerate(row, 1) if v is not None]
    frame = spark.createDataFrame(cells, "workbook_id string, sheet string, row int, col int, s string, n double")
    values = frame.select("workbook_id", "sheet", "row", "col", F.when(F.col("s").isNull(), V.number(F.col("n"))).otherwise(V.text(F.col("s"))).alias("value"))
    cases = [
        ('=VLOOKUP("FIG",S!$A$2:$C$6,2,FALSE)', 5.0), ('=VLOOKUP("kiwi",S!A2:C6,2,0)', "#N/A"), ('=IFERROR(VLOOKUP("kiwi",S!A2:C6,2,0),-1)+1', 0.0), ('=VLOOKUP("date",S!A2:C6,2,FALSE)', 0.0), ('=VLOOKUP("fig",S!A2:C6,2)', 9.0),
        ('=XLOOKUP(7,S!B2:B6,S!A2:A6)&"!"', "Plum!"), ('=XLOOKUP(8,S!B2:B6,S!A2:A6,"none")', "none"), ('=MATCH("plum",S!A2:A6,0)', 3.0), ('=INDEX(S!A2:C6,MATCH("z",S!C2:C6,0),1)', "fig"), ("=INDEX(S!A2:A6,9)", "#REF!"), ('=INDEX(S!B2:B6,MATCH("kiwi",S!A2:A6,0))', "#N/A"),
        ('=SUMIFS(S!B2:B6,S!A2:A6,"fig",S!C2:C6,"z")', 9.0), ('=SUMIF(S!A2:A6,"FIG",S!B2:B6)*2', 28.0), ('=COUNTIFS(S!C2:C6,"x")', 3.0), ('=COUNTIF(S!B2:B6,5)', 1.0), ('=SUMIFS(S!B2:B6,S!A2:A6,">a")', 24.0), ("=SUMPRODUCT(S!B2:B6,S!B2:B6)", 164.0), ('=SUM(VLOOKUP("fig",S!A2:B6,2,FALSE),COUNTIF(S!A2:A6,"fig"))', 7.0),
    ]
    rows = [("w", "T", i, 1, f) for i, (f, _) in enumerate(cases, 1)]
    out = {r.row: r.value for r in evaluate.evaluate(spark.createDataFrame(rows, "workbook_id string, sheet string, row int, col int, formula string"), values).collect()}
    for i, (f, want) in enumerate(cases, 1):
        v = out[i]
        assert {"num": v.n, "text": v.s, "error": v.err}.get(v.kind) == want, f


def test_long_chain_of_patterns(spark):
    rows = [("w", "S", 1, c, f"={'ABCDEFGHIJKLMNOPQRSTUVWXYZ'[c - 2]}1+{c}") for c in range(2, 14)]
    cells = spark.createDataFrame([("w", "S", 1, 1, 0.0)], "workbook_id string, sheet string, row int, col int, n double").withColumn("value", V.number(F.col("n")))
    out = evaluate.evaluate(spark.createDataFrame(rows, "workbook_id string, sheet string, row int, col int, formula string"), cells).collect()
    assert {r.col: r.value.n for r in out} == {c: sum(range(2, c + 1)) for c in range(2, 14)}


def test_levels_and_knots_of_a_graph():
    import numpy as np

    edges = [(1, 2), (2, 3), (3, 2), (3, 4), (5, 5), (6, 4), (7, 6), (1, 6)]
    found = evaluate.ordered(*(np.array(c) for c in zip(*edges, strict=True)))
    assert {r.pid: (r.level, None if pd.isna(r.knot) else r.knot) for r in found.itertuples()} == {1: (0, None), 2: (1, 2), 3: (1, 2), 4: (2, None), 5: (0, 5), 6: (1, None), 7: (0, None)}
    chain = evaluate.ordered(np.arange(50_000), np.arange(1, 50_001))
    assert chain.level.tolist() == list(range(50_001)) and chain.knot.isna().all()


def test_closure_ends_on_a_cycle(spark):
    edges = spark.createDataFrame([("w", "a", "b"), ("w", "b", "c"), ("w", "c", "a"), ("w", "c", "d")], "workbook_id string, src string, dst string")
    start = spark.createDataFrame([("w", "d")], "workbook_id string, id string")
    assert {(r.id, r.depth) for r in graph.closure(edges, start).collect()} == {("d", 0), ("c", 1), ("b", 2), ("a", 3)}


def test_query_sections(spark):
    text = 'section Garden;\n[Description = "a;b"] shared Beds = let t = "p;q" in t; // ; no\nshared #"Old ""beds""" = Beds & 1;\nshared Far = let a = Web.Contents("http://h/x"), b = Beds /* Old */ in {a, b, "Beds"};'
    members = code.sections(spark.createDataFrame([("w", text), ("w", None)], "workbook_id string, text string"))
    assert {(r.name, r.source) for r in members.filter("name <> 'Far'").collect()} == {("Beds", 'let t = "p;q" in t'), ('Old "beds"', "Beds & 1")}
    assert {(r.name, r.kind, r.target) for r in code.query_sources(members).collect()} == {('Old "beds"', "query", "Beds"), ("Far", "web", "http://h/x"), ("Far", "query", "Beds")}


def test_macros(spark):
    text = "\n".join([
        'Attribute VB_Name = "Beds"', "Private Static Sub Water()", '  Sheets("S").Range("A1", "A2").Offset(Row(1), 0).Value = Dose(Worksheets("S").Cells(1, "B")) \' Range("Q9")', '  note = "Range(""Z1"")" & [B7]', "  Beds.Dose 3", "End Sub",
        "Property Get Dose(x)", "  Dose = x + Cells(2, 28)", "End Property",
    ])
    owned = spark.createDataFrame([("w", "S", 1, 1, "c:S!A1"), ("w", "T", 1, 2, "c:T!B1")], "workbook_id string, sheet string, row int, col int, node_id string")
    modules = spark.createDataFrame([("w", "Beds", text), ("w", "Empty", 'Attribute VB_Name = "E"'), ("w", "None", None)], "workbook_id string, module string, code string")
    nodes, edges = code.macro_graph(modules, owned)
    assert {r.id for r in nodes.collect()} == {"vp:Beds.Water", "vp:Beds.Dose"}
    assert {(r.src, r.dst, r.kind) for r in edges.collect()} == {
        ("vp:Beds.Water", "vp:Beds.Dose", "call"), ("vp:Beds.Water", "c:S!A1", "vba-write"), ("i:S!B1", "vp:Beds.Water", "vba-read"), ("x:VBA:?!B7", "vp:Beds.Water", "vba-read"), ("x:VBA:?!AB2", "vp:Beds.Dose", "vba-read"),
    }
    kinds = {(r.proc, r.kind) for r in code.procedures(code.code_lines(modules)).select("proc", "kind").distinct().collect()}
    assert kinds == {("Water", "Sub"), ("Dose", "Property Get")}


CHEAP = ["cells_unpivot", "col_letters", "parse_refs", "r1c1_canonical", "pattern_groups", "pattern_topk_misc", "eval_vlookup", "eval_sumifs", "reconcile_values", "static_runs", "table_tags", "vba_refs", "query_sources", "token_estimate", "escapes"]


@pytest.mark.parametrize("name", CHEAP)
def test_queries_against_duckdb(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in names]
    df = entry.queries()[name](spark, sf)
    assert sorted(df.columns) == names
    near = lambda v: round(v, 6) if isinstance(v, float) else float(v) if type(v).__name__ == "Decimal" else v
    got = sorted((tuple(near(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(near(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
