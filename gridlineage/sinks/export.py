"""Graphs as files: Parquet or JSON lines for machines, one JSON document or an offline HTML page for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_text, script_safe
from ..operators.layout import drawing

#: Languages that a page's words exist in.
LANGUAGES = {"en": ("Lineage", "nodes", "edges", "All sheets"), "fr": ("Traçabilité", "nœuds", "liens", "Toutes les feuilles"), "de": ("Herkunft", "Knoten", "Kanten", "Alle Blätter"), "es": ("Trazabilidad", "nodos", "enlaces", "Todas las hojas")}


def write_graph(lineage, path: str, format: str = "parquet") -> None:
    """Nodes, edges, sheets and warnings of all workbooks under a folder, partitioned by nothing but the writer's tasks."""
    for name in ("nodes", "edges", "sheets", "warnings"):
        getattr(lineage, name).write.mode("overwrite").format(format).save(f"{path}/{name}")


def graph_json(lineage, docs: DataFrame | None = None, drawn: bool = False) -> DataFrame:
    """(workbook_id, graph): one JSON document for each workbook; `docs` (workbook_id, id, doc) are told with their nodes, '' where there is none.

    With `drawn`, it also holds where nodes and edges are drawn (`layout.drawing`).

    A document holds a workbook's nodes and edges, so this is for workbooks whose graph fits a row: at most
    400 patterns a sheet are nodes.
    """
    rows = lambda df, name: df.groupBy("workbook_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != "workbook_id"]))).alias(name))
    flat = lineage.nodes.withColumn("value", F.to_json("value")) if "value" in lineage.nodes.columns else lineage.nodes
    if docs is not None:
        told = docs.filter("id is not null and doc is not null").groupBy("workbook_id", "id").agg(F.min("doc").alias("doc"))
        flat = flat.drop("doc").join(told, ["workbook_id", "id"], "left").withColumn("doc", F.coalesce("doc", F.lit("")))
    out = rows(lineage.sheets, "sheets").join(rows(flat, "nodes"), "workbook_id", "left").join(rows(lineage.edges, "edges"), "workbook_id", "left").join(rows(lineage.warnings, "warnings"), "workbook_id", "left")
    parts = ["sheets", "nodes", "edges", "warnings"]
    if drawn:
        places, lines = drawing(lineage.nodes, lineage.edges)
        out, parts = out.join(rows(places, "places"), "workbook_id", "left").join(rows(lines, "lines"), "workbook_id", "left"), [*parts, "places", "lines"]
    return out.select("workbook_id", F.to_json(F.struct(*parts)).alias("graph"))


#: Draws what is shown of a graph: levels from left to right, links with their bends, labels as text.
DRAWING = (
    "const d=document.getElementById('d'),N='http://www.w3.org/2000/svg';function draw(v){d.textContent='';const at={},label={},of={};for(const x of v)label[x.id]=x.label||x.id;let wide=1;"
    "for(const p of g.places||[]){of[p.level]=(of[p.level]||0)+1;wide=Math.max(wide,p.level+1)}const high=Math.max(1,...Object.values(of))*26,X=l=>l*190+8,Y=y=>y/1e6*high;"
    "d.setAttribute('width',wide*190);d.setAttribute('height',high);for(const p of g.places||[])at[p.id]=p;const put=(n,o)=>{const e=document.createElementNS(N,n);for(const k in o)e.setAttribute(k,o[k]);d.append(e);return e};"
    "for(const l of g.lines||[])if(l.src in label&&l.dst in label)put('polyline',{points:l.points.map(p=>X(p.level)+(p.level>l.points[0].level?0:120)+','+Y(p.at)).join(' '),fill:'none',stroke:l.turned?'#b33':'#999'});"
    "for(const k in label)if(at[k]){put('rect',{x:X(at[k].level),y:Y(at[k].at)-9,width:120,height:18,fill:'#eef',stroke:'#669'});put('text',{x:X(at[k].level)+3,y:Y(at[k].at)+4,'font-size':10}).textContent=label[k].slice(0,22)}}"
)


def pages(lineage, language: str = "en", docs: DataFrame | None = None, drawn: bool = False) -> DataFrame:
    """(workbook_id, html): a page for each workbook that needs no network: its graph as a table, filtered by sheet and text, with documents if there are any, and with `drawn` as a drawing of what the filter shows."""
    if language not in LANGUAGES:
        raise ValueError(f"language must be one of {', '.join(LANGUAGES)}")
    title, nodes, edges, every = LANGUAGES[language]
    safe = script_safe(F.col("graph"))
    head = f'<!DOCTYPE html><html lang="{language}"><meta charset="utf-8"><title>'
    body = (
        f"<h1>{title}</h1><select id=s><option value=''>{every}</option></select><input id=q type=search><p id=n></p>{'<svg id=d></svg>' if drawn else ''}<table id=t></table><script>const g="
    )
    script = (
        f";{DRAWING if drawn else 'function draw(){}'};const s=document.getElementById('s'),q=document.getElementById('q'),t=document.getElementById('t');"
        "for(const x of g.sheets||[]){const o=document.createElement('option');o.textContent=x.sheet;s.append(o)}"
        "function show(){t.textContent='';const v=(g.nodes||[]).filter(x=>(!s.value||x.sheet===s.value)&&((x.label||'')+' '+(x.formula||'')).toLowerCase().includes(q.value.toLowerCase()));document.getElementById('n').textContent=v.length+' "
        f"{nodes}, '+(g.edges||[]).length+' {edges}';for(const x of v)"
        "{const r=t.insertRow();for(const c of [x.kind,x.label,x.formula||'',x.value||'',x.doc||''])r.insertCell().textContent=c}draw(v)}s.onchange=q.oninput=show;show()</script></html>"
    )
    return graph_json(lineage, docs, drawn).select("workbook_id", F.concat(F.lit(head), html_text(F.col("workbook_id")), F.lit("</title>"), F.lit(body), safe, F.lit(script)).alias("html"))


def iframe(html: str, height: int = 600) -> str:
    """A page inside a notebook's cell."""
    import base64

    return f'<iframe sandbox="allow-scripts" style="width:100%;height:{int(height)}px;border:0" src="data:text/html;base64,{base64.b64encode(html.encode()).decode()}"></iframe>'

