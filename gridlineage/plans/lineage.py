"""The whole analysis of a fleet of workbooks as one bundle of lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import refs as R
from ..functions import values as V
from ..functions.formulas import guard_fallback
from ..functions.programs import parsed
from ..operators import code, context, dossiers, edges, evaluate, graph, notices, patterns, reconcile, tables
from ..session import checkpointed, ship
from ..sources import sheets, workbooks


@dataclass
class Lineage:
    """What is known of the workbooks; every member is a DataFrame keyed by workbook_id."""

    cells: DataFrame
    formulas: DataFrame
    patterns: DataFrame
    values: DataFrame
    nodes: DataFrame
    edges: DataFrame
    sheets: DataFrame
    names: DataFrame
    tables: DataFrame
    structure: DataFrame
    warnings: DataFrame
    procedures: DataFrame | None = None

    def stats(self) -> DataFrame:
        return graph.stats(self.nodes, self.edges, self.formulas, self.names, self.tables)

    def find(self, text: str) -> DataFrame:
        return graph.find(self.nodes, text)

    def node(self, node_id: str) -> DataFrame:
        return graph.node(self.nodes, node_id)

    def precedents(self, node_id: str) -> DataFrame:
        return graph.precedents(self.nodes, self.edges, self.node(node_id))

    def dependents(self, node_id: str) -> DataFrame:
        return graph.dependents(self.nodes, self.edges, self.node(node_id))

    def dated(self) -> DataFrame:
        """Values with the dates of cells in date formats."""
        return context.dated(self.values, self.cells, self.structure)

    def examples(self) -> DataFrame:
        return context.examples(self.formulas)

    def heads(self) -> DataFrame:
        """The first values of each input range."""
        return context.heads(checkpointed(self.nodes.filter("kind = 'input'").select("workbook_id", R.parse_ref(F.col("label")).alias("target"))), self.values)

    def dossiers(self) -> DataFrame:
        """A JSON text for each workbook, and one for each formula or macro node (id is null for the former)."""
        whole = context.workbook_dossiers(self.structure, self.cells, self.patterns, self.formulas, self.procedures)
        return whole.select("workbook_id", F.lit(None).cast("string").alias("id"), "dossier").unionByName(dossiers.node_dossiers(self.nodes, self.edges))

    def documents(self, provider) -> DataFrame:
        """What a provider writes about every dossier (see `dossiers.documented`); `usage` of it sums up the tokens, `pages` puts it beside the nodes."""
        return checkpointed(dossiers.documented(self.dossiers(), provider))

    @staticmethod
    def usage(documents: DataFrame) -> DataFrame:
        """Tokens of each workbook's requests; those that failed didn't cost any."""
        return dossiers.usage(documents.filter("error is null").withColumnRenamed("doc", "reply"))

    def steps(self) -> DataFrame:
        """The evaluated steps of each pattern's representative, volatile ones left out."""
        return evaluate.steps(self.patterns.filter("not volatile").withColumn("program", parsed(F.col("formula"))), self.values.filter("value is not null"))


def analyze(spark: SparkSession, paths: str | list[str], modules: DataFrame | None = None, refs_dir: str | None = None) -> Lineage:
    """Reads workbooks and resolves everything in them.

    modules: the text of their macros (workbook_id, module, code). refs_dir: a folder in which linked
    workbooks are looked for; without it, links have what they keep of the other workbook.
    """
    ship(spark)
    books = workbooks.files(spark, paths)
    cells = checkpointed(workbooks.cells(workbooks.raw_cells(books)))
    outside = folder_values(spark, refs_dir) if refs_dir else None
    return resolved(cells, checkpointed(workbooks.structure(books)), modules, outside)


def resolved(cells: DataFrame, structure: DataFrame, modules: DataFrame | None = None, outside: tuple[DataFrame, DataFrame] | None = None) -> Lineage:
    """The analysis of cells and declarations, wherever they come from; `outside` has linked files and their cells."""
    place = ["workbook_id", "sheet", "row", "col"]
    formulas = checkpointed(patterns.relative(cells.filter("formula is not null").select(*place, "formula")))
    constants = cells.filter((F.col("formula").isNull()) & (F.col("value.kind") != "blank")).select(*place, "value")
    dims = sheets.dimensions(cells)
    grouped = checkpointed(patterns.groups(formulas))
    kept = checkpointed(patterns.top(grouped))
    owned = patterns.owners(formulas, grouped)

    declared = tables.defined_names(structure.filter("kind = 'name'").select("workbook_id", "name", F.col("sheet").alias("scope"), "ord", "text"))
    first = lambda t: R.parse_ref(F.trim(t))
    targets = F.filter(F.transform(F.split("text", ","), first), lambda d: d.isNotNull())
    names = declared.select("workbook_id", "name", F.transform(targets, lambda d: F.struct(*[d[f].alias(f) for f in ("sheet", "r1", "c1", "r2", "c2")])).alias("targets")).filter(F.size("targets") > 0)

    reads = checkpointed(edges.precedents(kept, dims).unionByName(clip(edges.name_reads(names), dims)))
    inputs = checkpointed(edges.input_ranges(reads, owned))
    named, opaque = edges.name_edges(reads, names)
    all_edges = sheets.union([edges.range_edges(reads, owned, kept), edges.input_edges(reads, inputs), edges.approximate_edges(reads, kept), named, opaque])
    kind = F.when(F.col("dst").startswith("n:"), "name").otherwise(F.col("kind"))
    all_edges = checkpointed(edges.merged(all_edges.withColumn("kind", kind)))

    links = structure.filter("kind = 'link'").select("workbook_id", F.col("ord").alias("index"), "name")
    files, there = outside if outside else (links.select(F.col("name"), F.lit("").alias("path"), "workbook_id").limit(0), constants.limit(0))
    linked, books = tables.external_cells(kept, links, files, there, workbooks.cached_cells(structure))
    linked = checkpointed(linked)

    # Stored values of formula cells come second to calculated ones.
    computed = evaluate.evaluate(formulas, constants.unionByName(linked), checkpointed(names))
    stored = cells.filter("formula is not null and value.kind <> 'blank'").select(*place, "value")
    flagged = formulas.select(*place, "formula", "volatile")
    fallback = fallbacks(formulas)
    values = checkpointed(reconcile.reconciled(flagged, computed, stored, fallback))

    shown = kept.select("workbook_id", "sheet", "rep_row", "rep_col", "node_id", "formula", "r1c1", "cells", "box", "volatile")
    at = values.select("workbook_id", "sheet", F.col("row").alias("rep_row"), F.col("col").alias("rep_col"), "value", "source")
    label = F.when(F.col("cells") == 1, F.concat(F.col("sheet"), F.lit("!"), R.a1(F.col("rep_row"), F.col("rep_col")))).otherwise(R.rect_to_a1(F.col("box")))
    formula_nodes = shown.join(at, ["workbook_id", "sheet", "rep_row", "rep_col"], "left").select("workbook_id", F.col("node_id").alias("id"), F.when(F.col("cells") == 1, "cell").otherwise("group").alias("kind"), label.alias("label"), "sheet", "formula", "r1c1", "cells", "value", "source")
    input_nodes = inputs.select("workbook_id", F.col("node_id").alias("id"), F.lit("input").alias("kind"), R.rect_to_a1(F.col("target")).alias("label"), F.col("target.sheet").alias("sheet"), R.ncells(F.col("target")).alias("cells"))
    name_nodes = names.select("workbook_id", F.concat(F.lit("n:"), F.col("name")).alias("id"), F.lit("name").alias("kind"), F.col("name").alias("label"))
    opaque_nodes = opaque.select("workbook_id", F.col("src").alias("id"), F.lit("opaque").alias("kind"), F.expr("substring(src, 3)").alias("label")).distinct()
    misc_nodes = patterns.rest(grouped).select("workbook_id", F.concat(F.lit("misc:"), F.col("sheet")).alias("id"), F.lit("misc").alias("kind"), F.col("sheet").alias("label"), "sheet", "cells")
    query_nodes, query_edges = queries(structure, names)
    # A range that a query reads or fills may be an input of formulas already.
    query_nodes = query_nodes.join(input_nodes.select("workbook_id", "id"), ["workbook_id", "id"], "left_anti")
    nodes = sheets.union([formula_nodes, input_nodes, name_nodes, opaque_nodes, misc_nodes, query_nodes])
    all_edges = all_edges.unionByName(query_edges)
    procedures = None
    if modules is not None:
        procedures = code.procedures(code.code_lines(modules)).select("workbook_id", "module", "proc", "kind").distinct()
        macro_nodes, macro_edges = code.macro_graph(modules, owned)
        ends = macro_edges.select("workbook_id", F.explode(F.array("src", "dst")).alias("id")).distinct().join(nodes.select("workbook_id", "id"), ["workbook_id", "id"], "left_anti").filter(F.col("id").rlike("^[ix]:"))
        new = ends.select("workbook_id", "id", F.when(F.col("id").startswith("i:"), "input").otherwise("opaque").alias("kind"), F.expr("substring(id, 3)").alias("label"))
        nodes, all_edges = sheets.union([nodes, macro_nodes.withColumnRenamed("code", "formula"), new]), all_edges.unionByName(macro_edges)

    t = structure.filter("kind = 'table'").withColumn("r", first(F.col("text")))
    found = t.select("workbook_id", "sheet", "name", F.lit("dynamic").alias("kind"), F.col("text").alias("ref"), F.col("r.r1").alias("header_row"), F.col("r.r2").alias("last_row"), F.col("r.c1").alias("first_col"), F.col("r.c2").alias("last_col"), F.col("list").alias("headers"), (F.col("r.r2") - F.col("r.r1")).alias("data_rows"))
    static = tables.static_tables(cells).join(found.select("workbook_id", "sheet").distinct(), ["workbook_id", "sheet"], "left_anti")
    every = found.unionByName(static, allowMissingColumns=True)

    differing = reconcile.origins(values, formulas, constants.unionByName(linked).unionByName(stored), evaluate.isolated, checkpointed(names))
    message = F.concat(F.col("sheet"), F.lit("!"), R.a1(F.col("row"), F.col("col")), F.lit(": calculated "), V.as_text(F.col("engine")), F.lit(", stored "), V.as_text(F.col("stored")), F.when(F.col("origin") == "inherited", " (by cells it reads)").otherwise(""))
    warnings = reconcile.capped(differing, message, ("sheet", "row", "col")).select("workbook_id", F.lit("values").alias("code"), "ord", "message")
    open_ = reconcile.uncomputed_named(values.filter("source is null and not volatile"), F.concat(F.col("sheet"), F.lit("!"), R.a1(F.col("row"), F.col("col"))), ("sheet", "row", "col"))
    left = F.when(F.col("n") > F.size("names"), F.concat(F.lit(" and "), (F.col("n") - F.size("names")).cast("string"), F.lit(" more"))).otherwise("")
    warnings = warnings.unionByName(open_.select("workbook_id", F.lit("uncomputed").alias("code"), F.lit(0).alias("ord"), F.concat(F.lit("no value: "), F.array_join("names", ", "), left).alias("message")))
    problems = structure.filter("kind = 'problem'").select("workbook_id", F.lit("file").alias("code"), F.lit(0).alias("ord"), F.col("text").alias("message"))
    said = notices.external_books(books)
    names_of = lambda c: F.array_join(c, ", ")
    outside_ = said.select("workbook_id", F.lit("links").alias("code"), F.lit(0).alias("ord"), F.concat_ws("; ", *[F.when(F.size(c) > 0, F.concat(F.lit(f"{c}: "), names_of(c))) for c in ("read", "cached", "missing")]).alias("message"))
    told = query_notices(structure)
    problems = problems.unionByName(outside_).unionByName(told)
    all_edges = all_edges.withColumn("id", F.concat(F.lit("e"), F.lower(F.hex(F.xxhash64("src", "dst", "kind")))))
    return Lineage(cells, formulas, kept, values.select(*place, "value", "source").unionByName(constants.withColumn("source", F.lit("constant"))), nodes, all_edges, dims, names, every, structure, warnings.unionByName(problems), procedures)


def clip(reads: DataFrame, dims: DataFrame) -> DataFrame:
    """Ranges of names cut to the used part of their sheets; those on no sheet are left out."""
    d = dims.select("workbook_id", F.col("sheet").alias("_on"), "max_row", "max_col")
    own = F.struct(*[F.col("target")[f].alias(f) for f in ("sheet", "r1", "c1", "r2", "c2")])
    out = reads.withColumn("_on", F.col("target.sheet")).join(d, ["workbook_id", "_on"])
    out = out.withColumn("target", R.clipped(own, F.col("max_row"), F.col("max_col"))).filter("target is not null")
    return out.withColumn("each", R.ncells(F.col("target"))).select(*reads.columns)


def fallbacks(formulas: DataFrame) -> DataFrame:
    """Values of the second argument of top-level guards, where that is a literal."""
    place = ["workbook_id", "sheet", "row", "col"]
    t = guard_fallback(F.col("formula"))
    number = t.try_cast("double")
    value = F.when(number.isNotNull(), V.number(number)).when(t.rlike('^"[^"]*"$'), V.text(F.regexp_replace(t, '^"|"$', "")))
    return formulas.select(*place, value.alias("value")).filter("value is not null")


def queries(structure: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the queries that workbooks hold.

    A table that a query reads is an input of its range, a name the name's node; sources outside are opaque
    nodes. A query that loads to a table has an edge to that range.
    """
    members = checkpointed(code.sections(structure.filter("kind = 'query'").select("workbook_id", "text")))
    reads = checkpointed(code.query_sources(members))
    nodes = members.select("workbook_id", F.concat(F.lit("q:"), F.col("name")).alias("id"), F.lit("query").alias("kind"), F.col("name").alias("label"), F.substring("source", 1, 6000).alias("formula"))
    found = structure.filter("kind = 'table'").select("workbook_id", "name", "sheet", F.col("text").alias("ref"))
    placed = code.placed_sources(reads, found, names)
    id_ = lambda kind, of: F.concat(F.lit(kind), of)
    src = F.when(F.col("place") == "table", id_("i:", F.col("ref"))).when(F.col("place") == "name", id_("n:", F.col("ref"))).otherwise(id_("x:", F.col("target")))
    own = placed.select("workbook_id", "name", src.alias("src"), F.when(F.col("place") == "table", "input").when(F.col("place") == "opaque", "opaque").alias("node"), F.coalesce("ref", "target").alias("label"))
    beyond = reads.filter("kind <> 'table'").select("workbook_id", "name", F.when(F.col("kind") == "query", id_("q:", F.col("target"))).otherwise(id_("x:", F.col("target"))).alias("src"), F.when(F.col("kind") != "query", "opaque").alias("node"), F.col("target").alias("label"))
    ends = checkpointed(own.unionByName(beyond))
    loaded = checkpointed(code.destinations(members, structure.filter("kind = 'load'").select("workbook_id", "name", "sheet", F.col("text").alias("ref"))))
    more = ends.filter("node is not null").select("workbook_id", F.col("src").alias("id"), F.col("node").alias("kind"), "label").unionByName(loaded.select("workbook_id", id_("i:", F.col("target")).alias("id"), F.lit("input").alias("kind"), F.col("target").alias("label"))).distinct()
    edge = lambda src, dst: ["workbook_id", src.alias("src"), dst.alias("dst"), F.lit("query").alias("kind"), F.lit(False).alias("approx")]
    edges_ = ends.select(*edge(F.col("src"), id_("q:", F.col("name")))).unionByName(loaded.select(*edge(id_("q:", F.col("name")), id_("i:", F.col("target"))))).distinct()
    return nodes.unionByName(more, allowMissingColumns=True), edges_


def query_notices(structure: DataFrame) -> DataFrame:
    """A warning for each workbook with queries: how many, how many load to a sheet, and what they read outside of it."""
    members = code.sections(structure.filter("kind = 'query'").select("workbook_id", "text"))
    loaded = code.destinations(members, structure.filter("kind = 'load'").select("workbook_id", "name", "sheet", F.col("text").alias("ref")))
    said = notices.queries(members, code.query_sources(members), loaded)
    outside = F.when(F.size("outside") > 0, F.concat(F.lit("; outside: "), F.array_join("outside", ", "), F.when(F.col("more") > 0, F.concat(F.lit(" and "), F.col("more").cast("string"), F.lit(" more"))).otherwise(""))).otherwise("")
    message = F.concat(F.col("queries").cast("string"), F.lit(" queries, "), F.col("loaded").cast("string"), F.lit(" loaded"), outside)
    return said.select("workbook_id", F.lit("queries").alias("code"), F.lit(0).alias("ord"), message.alias("message"))


def folder_values(spark: SparkSession, refs_dir: str) -> tuple[DataFrame, DataFrame]:
    """Linked files of a folder (at most two levels deep, the shallowest of a name), and their stored cells."""
    books = workbooks.files(spark, refs_dir, recursive=True)
    inside = F.regexp_replace(F.col("path"), f"^.*{refs_dir.rstrip('/').rpartition('/')[2]}/", "")
    listed = books.select("workbook_id", "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), (F.size(F.split(inside, "/")) - 1).alias("depth"))
    best = tables.shallowest_files(listed)
    return best, workbooks.cells(workbooks.raw_cells(books.join(best.select("workbook_id"), "workbook_id", "left_semi")))
