"""Command line: analyse workbooks and write their graph."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.refs import ncells, parse_ref
from .plans.lineage import analyze
from .sinks.export import LANGUAGES, graph_json, pages, write_graph
from .sources import workbooks


__version__ = "0.3.0"
#: Cells of a sheet that are read at most.
CEILING = 64_000_000


def inspected(structure: DataFrame) -> DataFrame:
    """Sheets with state, declared cells (of a `size` row: the range a sheet declares) and whether that is more than is read; and problems."""
    d = parse_ref(F.col("text"))
    size = structure.filter("kind = 'size'").select("workbook_id", "sheet", ncells(F.struct(*[d[f].alias(f) for f in ("sheet", "r1", "c1", "r2", "c2")])).alias("cells"))
    sheets = structure.filter("kind in ('sheet', 'problem')").select("workbook_id", "kind", "sheet", "ord", F.col("text").alias("state"))
    return sheets.join(size, ["workbook_id", "sheet"], "left").withColumn("truncated", F.coalesce(F.col("cells") > CEILING, F.lit(False))).orderBy("workbook_id", "ord")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridlineage", description=__doc__)
    parser.add_argument("paths", nargs="+", help="workbooks, or folders of them")
    parser.add_argument("--out", help="folder for nodes, edges, sheets and warnings")
    parser.add_argument("--format", choices=("parquet", "json"), default="parquet")
    parser.add_argument("--html", help="folder for one page a workbook")
    parser.add_argument("--language", choices=sorted(LANGUAGES), default="en")
    parser.add_argument("--no-html", action="store_true", help="write no pages, whatever --html says")
    parser.add_argument("--draw", action="store_true", help="draw the graph on pages, and tell places in JSON")
    parser.add_argument("--json", metavar="PATH", help="folder for one JSON document a workbook; - for standard output")
    parser.add_argument("--refs-dir", help="folder in which linked workbooks are looked for")
    parser.add_argument("--dry-run", action="store_true", help="list sheets alone, with their declared cells")
    parser.add_argument("--verbose", "-v", action="store_true", help="tell warnings too")
    parser.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("gridlineage").getOrCreate()
    try:
        if args.dry_run:
            inspected(workbooks.structure(workbooks.files(spark, args.paths))).show(1_000_000, False)
            return 0
        lineage = analyze(spark, args.paths, refs_dir=args.refs_dir)
        if args.json == "-":
            for row in graph_json(lineage, drawn=args.draw).toLocalIterator():
                print(row.graph)
        else:
            lineage.stats().show(1_000_000, False)
            if args.json:
                graph_json(lineage, drawn=args.draw).write.mode("overwrite").partitionBy("workbook_id").text(args.json)
        if args.verbose:
            for row in lineage.warnings.orderBy("workbook_id", "code", "ord").toLocalIterator():
                print(f"{row.workbook_id}: {row.message}", file=sys.stderr)
        if args.out:
            write_graph(lineage, args.out, args.format)
        if args.html and not args.no_html:
            pages(lineage, args.language, drawn=args.draw).write.mode("overwrite").partitionBy("workbook_id").text(args.html)
        return 0
    except KeyboardInterrupt:
        return 130
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        print(f"gridlineage: no such file: {e.getMessageParameters().get('path')}", file=sys.stderr)
        return 2
    except (OSError, ValueError) as e:
        print(f"gridlineage: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
