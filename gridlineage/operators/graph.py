"""Navigation and summaries of a graph of nodes (workbook_id, id, kind, label, sheet, ...) and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIDDEN_LIMIT = 30


def find(nodes: DataFrame, text: str | Column) -> DataFrame:
    """Nodes whose label or formula holds a text, without regard to case; every hit."""
    t = F.lower(F.lit(text) if isinstance(text, str) else text)
    hit = F.lower("label").contains(t)
    return nodes.filter(hit | F.coalesce(F.lower("formula").contains(t), F.lit(False))) if "formula" in nodes.columns else nodes.filter(hit)


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("id") == node_id)


def precedents(nodes: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    """Nodes one step before each (workbook_id, id) of `of`, with the edge kind; edges to no node are left out."""
    return _step(nodes, edges, of, "dst", "src")


def dependents(nodes: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    """Nodes one step behind each (workbook_id, id) of `of`, with the edge kind."""
    return _step(nodes, edges, of, "src", "dst")


def _step(nodes: DataFrame, edges: DataFrame, of: DataFrame, here: str, there: str) -> DataFrame:
    hops = edges.select("workbook_id", F.col(here).alias("of"), F.col(there).alias("id"), F.col("kind").alias("edge_kind"))
    wanted = of.select("workbook_id", F.col("id").alias("of")).distinct()
    return hops.join(wanted, ["workbook_id", "of"], "left_semi").join(nodes, ["workbook_id", "id"])


def closure(edges: DataFrame, start: DataFrame, upstream: bool = True, checkpoint=None) -> DataFrame:
    """(workbook_id, root, id, depth): everything that can be reached from (workbook_id, id) of `start`, and how far it is.

    Breadth first: each round joins the frontier with the edges and drops what was reached before, so
    cycles end. The roots themselves are at depth 0. An extension; the number of rounds is the depth.
    """
    from ..session import checkpointed

    cut = checkpoint or checkpointed
    a, b = ("dst", "src") if upstream else ("src", "dst")
    hops = cut(edges.select("workbook_id", F.col(a).alias("id"), F.col(b).alias("next")).distinct())
    seen = cut(start.select("workbook_id", F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct())
    front = seen
    depth = 0
    while True:
        depth += 1
        step = front.join(hops, ["workbook_id", "id"]).select("workbook_id", "root", F.col("next").alias("id")).distinct()
        front = cut(step.join(seen, ["workbook_id", "root", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def in_sheet(nodes: DataFrame, edges: DataFrame, sheet: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of a sheet with their neighbours, and the edges between nodes that are shown."""
    own = nodes.filter(F.col("sheet") == sheet).select("workbook_id", "id")
    ends = edges.select("workbook_id", F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select("workbook_id", F.col("dst").alias("id"), F.col("src").alias("other")))
    near = ends.join(own, ["workbook_id", "id"], "left_semi").select("workbook_id", F.col("other").alias("id"))
    shown = own.unionByName(near).distinct()
    end = lambda c: shown.select("workbook_id", F.col("id").alias(c))
    return nodes.join(shown, ["workbook_id", "id"], "left_semi"), edges.join(end("src"), ["workbook_id", "src"], "left_semi").join(end("dst"), ["workbook_id", "dst"], "left_semi")


def kind_counts(nodes: DataFrame) -> DataFrame:
    """Nodes of each kind in each sheet."""
    return nodes.groupBy("workbook_id", "sheet", "kind").agg(F.count("*").alias("n"))


def formula_counts(formulas: DataFrame) -> DataFrame:
    """Formulas of each sheet, and of each workbook in a row without a sheet."""
    return formulas.rollup("workbook_id", "sheet").agg(F.count("*").alias("formulas")).filter("workbook_id is not null")


def stats(nodes: DataFrame, edges: DataFrame, formulas: DataFrame, names: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """Counts of each workbook: formulas, nodes, edges, grouped patterns, names, tables."""
    count = lambda df, name: df.groupBy("workbook_id").agg(F.count("*").alias(name))
    out = count(formulas, "formulas").join(count(nodes, "nodes"), "workbook_id", "full").join(count(edges, "edges"), "workbook_id", "full")
    out = out.join(count(nodes.filter("kind = 'group'"), "grouped_patterns"), "workbook_id", "left")
    for name, df in (("defined_names", names), ("tables", tables)):
        if df is not None:
            out = out.join(count(df, name), "workbook_id", "full")
    return out.fillna(0)


def neighbours(nodes: DataFrame, edges: DataFrame, most: int = HIDDEN_LIMIT) -> DataFrame:
    """At most `most` neighbours on either side of each node, as arrays of (id, label, kind).

    A neighbour on both sides counts as one before. The limit is applied before rows are collected.
    """
    before = edges.select("workbook_id", F.col("dst").alias("id"), F.col("src").alias("other"), F.col("kind").alias("edge"), F.lit("precedents").alias("side"))
    after = edges.select("workbook_id", F.col("src").alias("id"), F.col("dst").alias("other"), F.col("kind").alias("edge"), F.lit("dependents").alias("side"))
    labels = nodes.select("workbook_id", F.col("id").alias("other"), "label")
    both = before.unionByName(after).join(labels, ["workbook_id", "other"])
    rank = F.row_number().over(Window.partitionBy("workbook_id", "id", "side").orderBy("other", "edge"))
    few = both.withColumn("rank", rank).filter(F.col("rank") <= most)
    lists = few.groupBy("workbook_id", "id").pivot("side", ["precedents", "dependents"]).agg(F.sort_array(F.collect_list(F.struct(F.col("other").alias("id"), "label", F.col("edge").alias("kind")))))
    return lists

