"""Workbook files as DataFrames: one job reads a fleet of .xlsx and .xlsm files.

Files are read with `binaryFile`; a task unpacks a file and streams its parts, so cells come out sparse, in
batches, and no dense grid is ever built. Everything but the parts themselves is columns and joins.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.refs import col_to_num, parse_ref

#: Cells of a batch.
BATCH = 20_000
#: A mashup of queries up to this size is unpacked; a larger one is a problem that is told.
MASHUP = 32 << 20
#: Built-in number formats that show a date or time.
DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
RAW = "workbook_id string, sheet string, ord int, a1 string, kind string, text string, formula string, shared string, style_date boolean"


def files(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """(workbook_id, path, content) of workbook files; the id is the file's path."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]")
    if recursive:
        read = read.option("recursiveFileLookup", "true")
    out = read.load(paths)
    return out.select(F.col("path").alias("workbook_id"), "path", "content")


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _rels(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets of a part's relationships by id."""
    folder, _, name = part.rpartition("/")
    try:
        root = ElementTree.fromstring(z.read(f"{folder}/_rels/{name}.rels"))
    except KeyError:
        return {}
    out = {}
    for r in root:
        path: list[str] = [] if r.get("Target", "").startswith("/") else folder.split("/")
        for step in r.get("Target", "").strip("/").split("/"):
            path = path[:-1] if step == ".." else [*path, step]
        out[r.get("Id")] = r.get("Target") if r.get("TargetMode") == "External" else "/".join(path)
    return out


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str, str]]:
    """(name, part, state) of the sheets in order."""
    rels = _rels(z, "xl/workbook.xml")
    root = ElementTree.fromstring(z.read("xl/workbook.xml"))
    rid = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    return [(s.get("name"), rels.get(s.get(rid), ""), s.get("state", "visible")) for s in root.iter() if local(s.tag) == "sheet"]


def _strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out: list[str] = []
    for _, e in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
        if local(e.tag) == "si":
            out.append("".join(t.text or "" for p in e if local(p.tag) in ("t", "r") for t in ([p] if local(p.tag) == "t" else [q for q in p if local(q.tag) == "t"])))
            e.clear()
    return out


def _date_styles(z: zipfile.ZipFile) -> list[bool]:
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")) for f in root.iter() if local(f.tag) == "numFmt"}
    dated = lambda i: i in DATES or (i in own and bool(re.search("[dmyhs]", own[i], re.I)) and own[i].lower() != "general")
    return [dated(int(x.get("numFmtId", 0))) for xs in root.iter() if local(xs.tag) == "cellXfs" for x in xs]


def raw_cells(books: DataFrame) -> DataFrame:
    """One row for each cell as a file writes it; files that are no workbook have none (see `problems`)."""

    def run(batches):
        for b in batches:
            for wid, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows: list[tuple] = []
                try:
                    z = zipfile.ZipFile(io.BytesIO(data.as_py()))
                    sheets, strings, dated = _sheets(z), _strings(z), _date_styles(z)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                for ord_, (name, part, _) in enumerate(sheets):
                    if part not in z.namelist():
                        continue
                    for _, e in ElementTree.iterparse(z.open(part)):
                        tag = local(e.tag)
                        if tag == "c":
                            kid = {local(k.tag): k for k in e}
                            f, v, kind = kid.get("f"), kid.get("v"), e.get("t", "n")
                            text = "".join(t.text or "" for t in kid["is"].iter() if local(t.tag) == "t") if "is" in kid else v.text if v is not None else None
                            if kind == "s" and text is not None:
                                text = strings[int(text)] if int(text) < len(strings) else None
                            style = int(e.get("s", 0))
                            shared = f.get("si") if f is not None and f.get("t") == "shared" else None
                            if text is not None or f is not None:
                                rows.append((wid, name, ord_, e.get("r"), "text" if kind in ("s", "str", "inlineStr") else {"b": "bool", "e": "error"}.get(kind, "num"), text, f.text if f is not None else None, shared, style < len(dated) and dated[style]))
                        if tag == "row":
                            e.clear()
                            if len(rows) >= BATCH:
                                yield _batch(rows)
                                rows = []
                if rows:
                    yield _batch(rows)

    return books.select("workbook_id", "content").mapInArrow(run, RAW)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [p.split()[0] for p in RAW.split(", ")])


def cells(raw: DataFrame) -> DataFrame:
    """(workbook_id, sheet, ord, row, col, value, is_date, formula): stored values tagged, shared formulas moved to their cells.

    A cell that repeats a shared formula takes the text of the cell that defines it, moved by their
    distance: references follow, anchored ones stay.
    """
    col, row = col_to_num(F.regexp_extract("a1", "^([A-Za-z]+)", 1)), F.regexp_extract("a1", "([0-9]+)$", 1).cast("int")
    t = F.col("text")
    value = (
        F.when(t.isNull() | (t == ""), V.blank()).when(F.col("kind") == "text", V.text(t)).when(F.col("kind") == "bool", V.boolean(t == "1"))
        .when(F.col("kind") == "error", V.error(t)).otherwise(V.number(t.try_cast("double")))
    )
    out = raw.select("workbook_id", "sheet", "ord", row.alias("row"), col.alias("col"), value.alias("value"), F.col("style_date").alias("is_date"), "formula", "shared")
    heads = out.filter("shared is not null and formula is not null").select("workbook_id", "sheet", "shared", F.col("formula").alias("_f"), F.col("row").alias("_r"), F.col("col").alias("_c"))
    heads = heads.groupBy("workbook_id", "sheet", "shared").agg(F.min_by(F.struct("_f", "_r", "_c"), F.struct("_r", "_c")).alias("h"))
    joined = out.join(heads, ["workbook_id", "sheet", "shared"], "left")
    own = moved(F.col("h._f"), F.col("row") - F.col("h._r"), F.col("col") - F.col("h._c"))
    formula = F.coalesce(F.col("formula"), F.when(F.col("h").isNotNull(), own))
    return joined.select("workbook_id", "sheet", "ord", "row", "col", "value", "is_date", F.when(formula.isNotNull(), F.concat(F.lit("="), formula)).alias("formula"))


def moved(formula, rows, cols):
    """Formula text with its relative references moved by a number of rows and columns."""
    from ..functions.formulas import is_area, tokens
    from ..functions.refs import body_of, let, num_to_col, quote_sheet, sheet_of

    def end(d, r, c):
        row = F.concat(F.when(d[f"{r}_abs"], "$").otherwise(""), F.when(d[f"{r}_abs"], d[r]).otherwise(d[r] + rows).cast("string"))
        return F.concat(F.when(d[f"{c}_abs"], "$").otherwise(""), num_to_col(F.when(d[f"{c}_abs"], d[c]).otherwise(d[c] + cols)), row)

    def one(t):
        def text(d):
            area = F.when(t.contains(":"), F.concat(end(d, "r1", "c1"), F.lit(":"), end(d, "r2", "c2"))).otherwise(end(d, "r1", "c1"))
            plain = body_of(t).rlike(r"^\$?[A-Za-z]+\$?[0-9]+(?::\$?[A-Za-z]+\$?[0-9]+)?$")
            return F.when(plain, F.concat(F.when(sheet_of(t).isNotNull(), F.concat(quote_sheet(sheet_of(t)), F.lit("!"))).otherwise(""), area)).otherwise(t)

        return F.when(is_area(t), let(parse_ref(t), text)).otherwise(t)

    return F.array_join(F.transform(tokens(formula), one), "")


def structure(books: DataFrame) -> DataFrame:
    """(workbook_id, kind, sheet, ord, name, text, list): what a workbook declares, one row for each thing.

    kind is sheet (text: state), name (name, sheet: scope, text: definition), table (name, sheet, text:
    range, list: headers), link (ord, name: file, text: target), cached (a cell that link `ord` keeps), load
    (name: query, sheet, text: range), merged and hidden (sheet, text: range or
    columns), comment (sheet, name: cell, text), size (sheet, text: the range it declares), frozen (sheet, text: the
    first cell that scrolls), epoch (text: 1904), query (text: the section), macros (name: part), problem (name:
    part, text).
    """
    schema = "workbook_id string, kind string, sheet string, ord int, name string, text string, list array<string>"

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for wid, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(data.as_py()))
                    rows += [(wid, *r) for r in _declared(z)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((wid, "problem", None, 0, None, f"not a workbook: {e}", None))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [p.split()[0] for p in schema.split(", ")])

    return books.select("workbook_id", "content").mapInArrow(run, schema)


def _declared(z: zipfile.ZipFile) -> list[tuple]:
    """Rows (kind, sheet, ord, name, text, list) of one workbook."""
    out: list[tuple] = []
    sheets, parts = _sheets(z), set(z.namelist())
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    rels = _rels(z, "xl/workbook.xml")
    rid = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    if any(local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter()):
        out.append(("epoch", None, 0, None, "1904", None))
    for i, e in enumerate(e for e in book.iter() if local(e.tag) == "definedName"):
        scope = sheets[int(e.get("localSheetId"))][0] if e.get("localSheetId") else None
        out.append(("name", scope, i, e.get("name"), e.text or "", None))
    for i, e in enumerate((e for e in book.iter() if local(e.tag) == "externalReference"), 1):
        part = rels.get(e.get(rid), "")
        target = next(iter(_rels(z, part).values()), "") if part in parts else ""
        out.append(("link", None, i, re.split(r"[\\/]", target)[-1], target, None))
        if part in parts:
            out += [("cached", *c) for c in _cached(z.read(part), i)]
    if "xl/vbaProject.bin" in parts:
        out.append(("macros", None, 0, "xl/vbaProject.bin", None, None))
    loads = _connections(z.read("xl/connections.xml")) if "xl/connections.xml" in parts else {}
    for i, (name, part, state) in enumerate(sheets):
        out.append(("sheet", name, i, None, state, None))
        if part not in parts:
            continue
        own = _rels(z, part)
        for _, e in ElementTree.iterparse(z.open(part)):
            tag = local(e.tag)
            if tag == "dimension":
                out.append(("size", name, 0, None, e.get("ref"), None))
            elif tag == "pane" and e.get("state") in ("frozen", "frozenSplit"):
                out.append(("frozen", name, 0, None, e.get("topLeftCell"), None))
            elif tag == "mergeCell":
                out.append(("merged", name, 0, None, e.get("ref"), None))
            elif tag == "col" and e.get("hidden") in ("1", "true"):
                out.append(("hidden", name, 0, None, f"{e.get('min')}:{e.get('max')}", None))
            elif tag == "tablePart" and own.get(e.get(rid)) in parts:
                t = ElementTree.fromstring(z.read(own[e.get(rid)]))
                for q in (q for q in _rels(z, own[e.get(rid)]).values() if "queryTable" in q and q in parts):
                    source = loads.get(ElementTree.fromstring(z.read(q)).get("connectionId"))
                    if source:
                        out.append(("load", name, 0, source, t.get("ref"), None))
                heads = [c.get("name") for c in t.iter() if local(c.tag) == "tableColumn"]
                out.append(("table", name, int(t.get("headerRowCount", 1)), t.get("displayName") or t.get("name"), t.get("ref"), heads))
            elif tag == "row":
                e.clear()
        for target in own.values():
            if "comments" in target and target in parts:
                for c in (c for c in ElementTree.fromstring(z.read(target)).iter() if local(c.tag) == "comment"):
                    out.append(("comment", name, 0, c.get("ref"), "".join(t.text or "" for t in c.iter() if local(t.tag) == "t"), None))
    for p in sorted(p for p in parts if re.fullmatch(r"customXml/item\d+\.xml", p)):
        xml = z.read(p)
        if len(xml) > MASHUP * 4 // 3:
            # Its length alone tells nothing of its kind, so the part's name is looked for at its beginning.
            if b"DataMashup" in xml[:4096]:
                out.append(("problem", None, 0, p, f"queries of {len(xml)} bytes are not read", None))
        elif text := _section(xml):
            out.append(("query", None, 0, None, text, None))
    return out


def _cached(xml: bytes, link: int) -> list[tuple]:
    """Rows (sheet, ord: link, name: cell, text, list: type) of the cells that a link keeps of another workbook."""
    root, out = ElementTree.fromstring(xml), []
    names = [e.get("val") for e in root.iter() if local(e.tag) == "sheetName"]
    for data in (e for e in root.iter() if local(e.tag) == "sheetData"):
        at = int(data.get("sheetId", -1))
        for c in (c for c in data.iter() if local(c.tag) == "cell" and 0 <= at < len(names)):
            text = next((v.text for v in c if local(v.tag) == "v"), None)
            if text is not None:
                out.append((names[at], link, c.get("r"), text, [c.get("t", "n")]))
    return out


def _connections(xml: bytes) -> dict[str, str]:
    """The query behind each connection's id, as its connection string names it."""
    out = {}
    for c in (c for c in ElementTree.fromstring(xml).iter() if local(c.tag) == "connection"):
        text = ";".join(d.get("connection", "") for d in c if local(d.tag) == "dbPr")
        fields = dict(f.split("=", 1) for f in text.split(";") if "=" in f)
        if "mashup" in fields.get("Provider", "").lower() and fields.get("Location"):
            out[c.get("id")] = fields["Location"].strip('"')
    return out


def cached_cells(structure: DataFrame) -> DataFrame:
    """(workbook_id, link, sheet, row, col, value) of the cells that links keep."""
    from ..functions.refs import parse_ref

    t, kind = F.col("text"), F.col("list")[0]
    value = F.when(kind == "e", V.error(t)).when(kind == "b", V.boolean(t == "1")).when(kind == "str", V.text(t)).when(t.try_cast("double").isNotNull(), V.number(t.try_cast("double"))).otherwise(V.text(t))
    d = parse_ref(F.col("name"))
    return structure.filter("kind = 'cached'").select("workbook_id", F.col("ord").alias("link"), "sheet", d["r1"].alias("row"), d["c1"].alias("col"), value.alias("value"))


def _section(xml: bytes) -> str | None:
    """The query section inside a mashup part: base64 of a length, a zip and more."""
    import base64

    try:
        root = ElementTree.fromstring(xml)
        if local(root.tag) != "DataMashup":
            return None
        data = base64.b64decode(root.text)
        size = int.from_bytes(data[4:8], "little")
        return zipfile.ZipFile(io.BytesIO(data[8 : 8 + size])).read("Formulas/Section1.m").decode("utf-8-sig")
    except (ElementTree.ParseError, ValueError, KeyError, zipfile.BadZipFile):
        return None
