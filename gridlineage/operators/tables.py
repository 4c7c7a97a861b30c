"""Tables inside sheets, defined names, and files: who comes first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.refs import num_to_col
from ..session import checkpointed

#: The corner of a sheet in which blocks without a declaration are looked for, and what makes one.
ROWS, COLUMNS, LEAST_COLUMNS, LEAST_ROWS = 30, 50, 2, 2
SHEET = ("workbook_id", "sheet")


def text_runs(cells: DataFrame, rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """(workbook_id, sheet, row, first_col, last_col): the longest run of text cells of each row; the first of equals."""
    texts = cells.filter((F.col("value.kind") == "text") & (F.col("row") <= rows) & (F.col("col") <= columns))
    island = F.col("col") - F.row_number().over(Window.partitionBy(*SHEET, "row").orderBy("col"))
    runs = texts.withColumn("island", island).groupBy(*SHEET, "row", "island").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"))
    longest = runs.groupBy(*SHEET, "row").agg(F.max(F.struct((F.col("last_col") - F.col("first_col")).alias("n"), (-F.col("first_col")).alias("left"), "first_col", "last_col")).alias("r"))
    return longest.select(*SHEET, "row", "r.first_col", "r.last_col")


def static_tables(cells: DataFrame, rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """Blocks that look like tables: a row of headers over rows that are not blank below it.

    A header is the longest run of texts of its row, of LEAST_COLUMNS at least; the block ends before the
    first row that is blank in these columns and has LEAST_ROWS rows of data. A header inside an earlier
    block is data. Blocks are found in row order, so a header is dropped if any kept block above covers it.
    """
    window = cells.filter((F.col("row") <= rows) & (F.col("col") <= columns))
    heads = text_runs(cells, rows, columns).filter(F.col("last_col") - F.col("first_col") + 1 >= LEAST_COLUMNS).withColumnRenamed("row", "header_row")
    inside = heads.join(window.select(*SHEET, "row", "col"), list(SHEET)).filter((F.col("row") > F.col("header_row")) & F.col("col").between(F.col("first_col"), F.col("last_col")))
    filled = inside.groupBy(*SHEET, "header_row", "first_col", "last_col").agg(F.array_sort(F.collect_set("row")).alias("filled"))
    gapless = F.size(F.filter("filled", lambda r: F.array_position("filled", r) == r - F.col("header_row")))
    blocks = filled.withColumn("data_rows", gapless).filter(F.col("data_rows") >= LEAST_ROWS).withColumn("last_row", F.col("header_row") + F.col("data_rows"))
    # At most `rows` headers a sheet, taken in order: a fold keeps those that no kept one covers.
    each = F.struct("header_row", "first_col", "last_col", "last_row", "data_rows")
    lists = blocks.groupBy(*SHEET).agg(F.array_sort(F.collect_list(each)).alias("all"))
    covers = lambda k, b: (b["header_row"] <= k["last_row"]) & (b["first_col"] <= k["last_col"]) & (b["last_col"] >= k["first_col"])
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, b: F.when(F.exists(acc, lambda k: covers(k, b)), acc).otherwise(F.concat(acc, F.array(b))))
    found = lists.select(*SHEET, F.explode(kept).alias("t")).select(*SHEET, "t.*")
    heads_ = cells.select(*SHEET, F.col("row").alias("header_row"), "col", "value.s")
    named = found.join(heads_, [*SHEET, "header_row"]).filter(F.col("col").between(F.col("first_col"), F.col("last_col")))
    names = F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("s", F.concat(F.lit("Column "), num_to_col(F.col("col")))).alias("s")))), lambda x: x["s"])
    return named.groupBy(*SHEET, "header_row", "first_col", "last_col", "last_row", "data_rows").agg(names.alias("headers")).withColumn("kind", F.lit("static"))


def tagged(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Cells with the table that holds them (the first by `ord`), the header of their column and their data row; 0 for headers.

    `tables` has workbook_id, sheet, name, ord, header_row, last_row, first_col, last_col, headers, and is
    joined by sheet; there are few tables to a sheet.
    """
    t = tables.select(*SHEET, F.struct("ord", "name", "header_row", "last_row", "first_col", "last_col", "headers").alias("t"))
    hit = cells.join(t, list(SHEET)).filter(F.col("row").between(F.col("t.header_row"), F.col("t.last_row")) & F.col("col").between(F.col("t.first_col"), F.col("t.last_col")))
    best = hit.groupBy(*SHEET, "row", "col").agg(F.min_by("t", "t.ord").alias("t"))
    header = F.try_element_at("t.headers", (F.col("col") - F.col("t.first_col") + 1).cast("int"))
    return best.select(*SHEET, "row", "col", F.col("t.name").alias("table"), header.alias("column"), F.greatest(F.lit(0), F.col("row") - F.col("t.header_row")).alias("table_row"))


def first_of(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group: names by scope, files by depth and path, tables by declaration."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_rank = 1").drop("_rank")


def defined_names(names: DataFrame) -> DataFrame:
    """Each name once: that of the workbook before those of sheets in their order; built-in names left out.

    `names` has workbook_id, name, scope (null for the workbook), ord.
    """
    own = names.filter(~F.col("name").startswith("_xlnm.")).withColumn("key", F.upper("name"))
    return first_of(own, ["workbook_id", "key"], [F.col("scope").isNotNull(), F.col("ord")]).drop("key")


def shallowest_files(files: DataFrame, depth: int = 2) -> DataFrame:
    """Files (path, name, depth) by name without case: the shallowest, then the first path."""
    return first_of(files.filter(F.col("depth") <= depth).withColumn("key", F.lower("name")), ["key"], ["depth", "path"])


def external_books(refs: DataFrame, declared: DataFrame, files: DataFrame) -> DataFrame:
    """Where each external reference is read: declared book by number, else by name; a file of that name before the cache.

    `refs` has workbook_id and book (a number or a name); `declared` workbook_id, index, name, cached;
    `files` name and path. Adds `target` (the book's name), `path` and `read` (folder, cache or none).
    """
    numbered = declared.select("workbook_id", F.col("index").cast("string").alias("book"), F.col("name").alias("by_number"), F.col("cached").alias("cached_number"))
    named = declared.select("workbook_id", F.lower("name").alias("low"), F.col("name").alias("by_name"), F.col("cached").alias("cached_name")).dropDuplicates(["workbook_id", "low"])
    out = refs.join(numbered, ["workbook_id", "book"], "left").withColumn("low", F.lower("book")).join(named, ["workbook_id", "low"], "left").drop("low")
    out = out.withColumn("target", F.coalesce("by_number", "by_name", F.when(~F.col("book").rlike("^[0-9]+$"), F.col("book"))))
    out = out.withColumn("low", F.lower("target")).join(files.select(F.lower("name").alias("low"), "path"), "low", "left")
    cached = F.coalesce("cached_number", "cached_name", F.lit(False))
    read = F.when(F.col("path").isNotNull(), "folder").when(cached, "cache").otherwise("none")
    return out.withColumn("read", read).drop("low", "by_number", "by_name", "cached_number", "cached_name")


def external_values(refs: DataFrame, folder: DataFrame, cache: DataFrame) -> DataFrame:
    """Values of external cells: what a file holds beats what was cached; that a key is there decides, not that a value is set."""
    key = ["workbook_id", "target", "sheet", "row", "col"]
    side = lambda df, c: df.select(*key, F.struct(F.col("value")).alias(c))
    out = refs.join(side(folder, "_f"), key, "left").join(side(cache, "_c"), key, "left")
    value = F.when(F.col("_f").isNotNull(), F.col("_f.value")).otherwise(F.col("_c.value"))
    source = F.when(F.col("_f").isNotNull(), "external").when(F.col("_c").isNotNull(), "external-cache")
    return out.withColumns({"value": value, "source": source}).drop("_f", "_c")


def external_cells(patterns: DataFrame, links: DataFrame, files: DataFrame, folder: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of other workbooks as cells of sheets of the one that reads them, named as formulas name them; and the books (workbook_id, node_id, target, read).

    `patterns` has workbook_id, node_id, formula; `links` workbook_id, index, name; `files` name, path and
    workbook_id; `folder` the cells of the files; `cache` what links keep (workbook_id, link, ...). A file
    comes before the cache; only cells that formulas name are taken.
    """
    from ..functions.formulas import external_refs
    from ..functions.refs import parse_ref
    from .edges import cells_in

    refs = checkpointed(patterns.filter("formula like '%[%'").select("workbook_id", "node_id", F.explode(external_refs(F.col("formula"))).alias("x")).select("workbook_id", "node_id", "x.*"))
    declared = links.join(cache.select("workbook_id", F.col("link").alias("index"), F.lit(True).alias("cached")).distinct(), ["workbook_id", "index"], "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    books = external_books(refs, declared, files.select("name", "path"))
    named = F.concat("dir", F.lit("["), "book", F.lit("]"), "sheet")
    wanted = books.select("workbook_id", "book", F.lower("target").alias("file"), "sheet", named.alias("as"), parse_ref(F.col("cell")).alias("d")).filter("d is not null and file is not null").distinct()
    wanted = checkpointed(wanted)
    rect_ = F.struct(F.col("sheet").alias("sheet"), *[F.col("d")[f].alias(f) for f in ("r1", "c1", "r2", "c2")])

    def taken(asks: DataFrame, cells: DataFrame) -> DataFrame:
        # cells_in matches by workbook, sheet and bin; here the workbook is the other one.
        hit = cells_in(asks.withColumn("target", rect_), cells)
        return hit.select(F.col("reader").alias("workbook_id"), F.col("as").alias("sheet"), F.col("cell_row").alias("row"), F.col("cell_col").alias("col"), F.col("cell_value").alias("value"))

    held = files.select(F.lower("name").alias("file"), F.col("workbook_id").alias("_other"))
    of_files = wanted.join(held, "file").withColumnRenamed("workbook_id", "reader").withColumnRenamed("_other", "workbook_id")
    from_files = taken(of_files, folder.select("workbook_id", "sheet", "row", "col", "value"))
    numbered = links.select("workbook_id", F.col("index").alias("link"), F.lower("name").alias("file"))
    of_cache = wanted.join(numbered, ["workbook_id", "file"]).withColumn("reader", F.col("workbook_id")).withColumn("workbook_id", F.concat_ws("\n", "workbook_id", F.col("link").cast("string")))
    kept = cache.select(F.concat_ws("\n", "workbook_id", F.col("link").cast("string")).alias("workbook_id"), "sheet", "row", "col", "value")
    from_cache = taken(of_cache, kept)
    both = from_files.withColumn("_first", F.lit(0)).unionByName(from_cache.withColumn("_first", F.lit(1)))
    cells = both.groupBy("workbook_id", "sheet", "row", "col").agg(F.min_by("value", "_first").alias("value"))
    return cells, books.select("workbook_id", "node_id", "target", "read").distinct()
