"""Layered drawings of graphs: a level for each node, bends on long edges, and an order in each level that follows its neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .ordered import placed

#: Height of a drawing: places in a level are spread over it.
HEIGHT = 1_000_000
#: Passes over the levels, down and up in turn.
PASSES = 4


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(workbook_id, id, level): sources are at level 0, every other node one beyond the last of its precedents.

    Each round takes the nodes that nothing left leads to, so there are as many rounds as levels. Where a circle leaves a
    workbook none, its least id is taken, and the edges that still lead to it go upwards. Edges from a
    node to itself and to or from no node don't count; a null or repeated id is one node.
    """
    open_ = checkpointed(nodes.select("workbook_id", "id").distinct())
    left = checkpointed(links(open_, edges))
    done = []
    while not open_.isEmpty():
        free = open_.join(left.select("workbook_id", F.col("dst").alias("id")).distinct(), ["workbook_id", "id"], "left_anti")
        stuck = open_.join(free.select("workbook_id").distinct(), "workbook_id", "left_anti").groupBy("workbook_id").agg(F.min("id").alias("id"))
        free = checkpointed(free.unionByName(stuck).withColumn("level", F.lit(len(done))))
        done.append(free)
        taken = free.select("workbook_id", "id")
        open_ = checkpointed(open_.join(taken, ["workbook_id", "id"], "left_anti"))
        left = checkpointed(left.join(taken.withColumnRenamed("id", "src"), ["workbook_id", "src"], "left_anti").join(taken.withColumnRenamed("id", "dst"), ["workbook_id", "dst"], "left_anti"))
    return checkpointed(reduce(DataFrame.unionByName, done)) if done else open_.withColumn("level", F.lit(0))


def links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The different (workbook_id, src, dst) among nodes, but those from a node to itself."""
    end = lambda c: nodes.select("workbook_id", F.col("id").alias(c))
    out = edges.filter("src <> dst").select("workbook_id", "src", "dst").distinct()
    return out.join(end("src"), ["workbook_id", "src"], "left_semi").join(end("dst"), ["workbook_id", "dst"], "left_semi")


def pieces(levelled: DataFrame, edges: DataFrame) -> DataFrame:
    """(workbook_id, src, dst, turned, level, upper, lower): every link cut at the levels it passes, from the upper end to the lower.

    A link that goes upwards is turned. Where it passes a level it has a bend, a place of its own named by its ends and the level.
    """
    end = lambda c, as_: levelled.select("workbook_id", F.col("id").alias(c), F.col("level").alias(as_))
    out = links(levelled, edges).join(end("src", "a"), ["workbook_id", "src"]).join(end("dst", "b"), ["workbook_id", "dst"])
    out = out.withColumns({"turned": F.col("a") > F.col("b"), "top": F.least("a", "b"), "low": F.greatest("a", "b")}).withColumn("level", F.explode(F.sequence("top", F.col("low") - 1)))
    first, last = F.when(F.col("turned"), F.col("dst")).otherwise(F.col("src")), F.when(F.col("turned"), F.col("src")).otherwise(F.col("dst"))
    bend = lambda level: F.concat(F.lit("b:"), "src", F.lit(">"), "dst", F.lit("#"), level.cast("string"))
    upper = F.when(F.col("level") == F.col("top"), first).otherwise(bend(F.col("level")))
    lower = F.when(F.col("level") + 1 == F.col("low"), last).otherwise(bend(F.col("level") + 1))
    return out.select("workbook_id", "src", "dst", "turned", "level", upper.alias("upper"), lower.alias("lower"))


def numbered(places: DataFrame, *order: Column) -> DataFrame:
    """(workbook_id, level, id, rank, at): places of each level in an order, then by id; `at` spreads them over HEIGHT."""
    keys = [f"k{i}" for i in range(len(order))]
    rows = places.select("workbook_id", "level", "id", *[c.alias(k) for k, c in zip(keys, order, strict=True)], F.lit(0).alias("tie"), F.col("id").alias("spread"))
    ranked = placed(rows, ["workbook_id", "level"], keys, "id").withColumnRenamed("before", "rank")
    sizes = places.groupBy("workbook_id", "level").agg(F.count("*").alias("n"))
    return checkpointed(ranked.join(sizes, ["workbook_id", "level"]).select("workbook_id", "level", "id", "rank", F.expr(f"((2 * rank - 1) * {HEIGHT}L) div (2 * n)").alias("at")))


def ordered(levelled: DataFrame, cut: DataFrame, passes: int = PASSES) -> DataFrame:
    """(workbook_id, level, id, rank, at) of nodes and bends after so many passes of the barycentre rule.

    A pass puts each place at the mean of its neighbours in the level above (every second pass: below); those without any stay.
    All levels move at once, from where the pass before left them. Ties keep their order. Means are whole numbers, so
    the result doesn't depend on how rows are dealt.
    """
    bends = cut.filter(F.col("upper").startswith("b:")).select("workbook_id", F.col("upper").alias("id"), "level")
    own = levelled.select("workbook_id", "id", "level")
    now = numbered(own.unionByName(bends.join(own.select("workbook_id", "id"), ["workbook_id", "id"], "left_anti").distinct()))
    for k in range(passes):
        here, there = ("lower", "upper") if k % 2 == 0 else ("upper", "lower")
        near = cut.select("workbook_id", F.col(here).alias("of"), F.col(there).alias("id")).join(now.select("workbook_id", "id", "at"), ["workbook_id", "id"])
        mean = near.groupBy("workbook_id", F.col("of").alias("id")).agg(F.expr("sum(at) div count(*)").alias("mean"))
        now = now.join(mean, ["workbook_id", "id"], "left")
        now = numbered(now, F.coalesce("mean", "at"), F.col("rank"))
    return now


def drawing(nodes: DataFrame, edges: DataFrame, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """Where to draw a graph: (workbook_id, id, level, at) of its nodes, and (workbook_id, src, dst, turned, points) of its links.

    `at` goes from 0 to HEIGHT; points are (level, at) from the upper end to the lower, with a bend at each level between. Every
    node has a place, those without links at level 0; an empty graph gives empty results.
    """
    levelled = levels(nodes, edges)
    cut = checkpointed(pieces(levelled, edges))
    places = ordered(levelled, cut, passes)
    at = places.select("workbook_id", "id", "level", "at")
    ends = cut.select("workbook_id", "src", "dst", "turned", F.explode(F.array("upper", "lower")).alias("id")).distinct()
    points = F.sort_array(F.collect_list(F.struct("level", "at"))).alias("points")
    lines = ends.join(at, ["workbook_id", "id"]).groupBy("workbook_id", "src", "dst", "turned").agg(points)
    return at.join(levelled.select("workbook_id", "id"), ["workbook_id", "id"], "left_semi"), lines
