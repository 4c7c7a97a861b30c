"""What is told about nodes and workbooks: JSON dossiers of bounded size, documents under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shortened, token_estimate
from ..session import checkpointed
from .context import LONGEST
from .graph import neighbours

NODE_CHARS, CODE_CHARS = 6000, 2500


def node_dossiers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(workbook_id, id, dossier) as JSON for formula and macro nodes; the code is shortened, and left out where the whole is too long."""
    near = nodes.filter(F.col("kind").isin("cell", "group", "vba")).join(neighbours(nodes, edges), ["workbook_id", "id"], "left")
    optional = [c for c in ("sheet", "formula", "cells", "value", "source") if c in nodes.columns]
    own = ["id", "kind", "label", *optional]
    code = shortened(F.col("code"), CODE_CHARS) if "code" in nodes.columns else F.lit(None).cast("string")
    full = F.to_json(F.struct(*own, code.alias("code"), "precedents", "dependents"))
    short = F.to_json(F.struct(*own, F.lit(True).alias("truncated"), F.slice("precedents", 1, 5).alias("precedents"), F.slice("dependents", 1, 5).alias("dependents")))
    return near.select("workbook_id", "id", F.when(F.length(full) > NODE_CHARS, short).otherwise(full).alias("dossier"))


def within_budget(rows: DataFrame, tokens: Column, order: list[str], budget: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows in order as long as what was spent before is below the budget; the last one may pass it.

    Rows are sorted in ranges of groups and order; sums of ranges, not rows, are cumulated, so a group that
    holds most rows is summed by many tasks.
    """
    if budget <= 0:
        raise ValueError("the budget must be positive")
    keys = [*by, *order]
    ranged = checkpointed(rows.withColumn("tokens", tokens).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_part").agg(F.sum("tokens").alias("_n"))
    before = checkpointed(sums.select(*by, "_part", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")).alias("_base")))
    # Ranges that begin beyond the budget have no row to keep.
    joined = ranged.join(before.filter(F.col("_base") < budget), [*by, "_part"])
    w = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("spent", F.col("_base") + F.coalesce(F.sum("tokens").over(w), F.lit(0))).filter(F.col("spent") < budget).drop("_part", "_base")


def usage(requests: DataFrame) -> DataFrame:
    """Tokens of each workbook's requests (tokens_in, tokens_out, prompt, reply): what is reported counts, what isn't is estimated, either by itself."""
    one = requests.select("workbook_id", F.coalesce("tokens_in", token_estimate(F.col("prompt"))).alias("i"), F.coalesce("tokens_out", token_estimate(F.col("reply"))).alias("o"), (F.col("tokens_in").isNull() | F.col("tokens_out").isNull()).alias("e"))
    return one.groupBy("workbook_id").agg(F.sum("i").alias("tokens_in"), F.sum("o").alias("tokens_out"), F.count("*").alias("requests"), F.max("e").alias("estimated"))


def documented(dossiers: DataFrame, provider, node_chars: int = NODE_CHARS, workbook_chars: int = LONGEST) -> DataFrame:
    """(workbook_id, id, prompt, doc, tokens_in, tokens_out, error): a provider asked for each dossier.

    A provider is a function from prompt to text, or an object with `generate`, or with `generate_with_usage`,
    which gives the text and the tokens of prompt and reply (null where it doesn't know). Calls run in tasks;
    one that fails leaves an error in its row and the others go on. A dossier above the bound of its kind
    (without id: a workbook's) is an error too: parts are shed before, and half of a JSON text says nothing.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = []
            for id_, prompt in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    if len(prompt) > (workbook_chars if id_ is None else node_chars):
                        raise ValueError(f"dossier of {len(prompt)} characters")
                    if hasattr(provider, "generate_with_usage"):
                        text, used, made = provider.generate_with_usage(prompt)
                    else:
                        text, used, made = (provider.generate if hasattr(provider, "generate") else provider)(prompt), None, None
                    rows.append((str(text), used, made, None))
                except Exception as e:  # noqa: BLE001  a provider may raise anything
                    rows.append((None, None, None, f"{type(e).__name__}: {e}"))
            docs, used, made, errors = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(docs, pa.string()), pa.array(used, pa.int64()), pa.array(made, pa.int64()), pa.array(errors, pa.string())], ["workbook_id", "id", "prompt", "doc", "tokens_in", "tokens_out", "error"])

    return dossiers.select("workbook_id", "id", F.col("dossier").alias("prompt")).mapInArrow(run, "workbook_id string, id string, prompt string, doc string, tokens_in long, tokens_out long, error string")
