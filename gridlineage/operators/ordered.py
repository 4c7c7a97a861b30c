"""Places in an order, and tiles of places: what range queries need that neither pair rows nor sort a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Tiles of one size make one of the next by this factor (two bits of a place).
FACTOR = 4


#: Rows of a stored table that may be broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """A hint to broadcast a stored table of few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def in_tiles(df: DataFrame, first: Column, last: Column, name: str, sizes: int) -> DataFrame:
    """A row with `name` (size, at) for each of the tiles that make up places first to last: at each size those whole tiles that no larger one holds.

    No more than FACTOR - 1 of a size lie at either end, so these are tried, and those that fit stay. Where
    last comes before first there are none. `sizes` must do for the last place (see `sizes_for`).
    """
    ends = 2 * (FACTOR - 1)
    out = df.withColumns({"_a": first.cast("long"), "_b": last.cast("long") + 1}).withColumn("_j", F.explode(F.lit(list(range(ends * sizes)))))
    out = out.withColumns({"_k": F.expr(f"2 * (_j div {ends})"), "_i": F.col("_j") % ends})
    up = lambda k: f"shiftright(_a + shiftleft(1L, cast({k} as int)) - 1, cast({k} as int))"
    down = lambda k: f"shiftright(_b, cast({k} as int))"
    out = out.withColumns({"_lo": F.expr(up("_k")), "_hi": F.expr(down("_k")), "_in": F.expr(f"if(_k < {2 * sizes - 2}, {FACTOR} * {up('_k + 2')}, 0L)"), "_out": F.expr(f"if(_k < {2 * sizes - 2}, {FACTOR} * {down('_k + 2')}, 0L)")})
    at = F.when((F.col("_in") < F.col("_out")) & (F.col("_i") >= FACTOR - 1), F.col("_out") + F.col("_i") - (FACTOR - 1)).otherwise(F.col("_lo") + F.col("_i"))
    left = F.when(F.col("_in") < F.col("_out"), F.when(F.col("_i") < FACTOR - 1, F.col("_in")).otherwise(F.col("_hi"))).otherwise(F.col("_hi"))
    out = out.withColumns({"_at": at, "_left": left}).filter((F.col("_at") < F.col("_left")) & (F.col("_a") < F.col("_b")))
    return out.withColumn(name, F.struct(F.expr("cast(_k div 2 as int)").alias("size"), F.col("_at").alias("at"))).drop("_a", "_b", "_j", "_k", "_i", "_lo", "_hi", "_in", "_out", "_at", "_left")


def by_tile(df: DataFrame, place: Column, name: str, sizes: int) -> DataFrame:
    """A row with `name` (size, at) for each of the tiles that hold a place, one of each size."""
    out = df.withColumn("_a", place.cast("long")).withColumn("_k", F.explode(F.lit(list(range(sizes)))))
    return out.withColumn(name, F.struct(F.col("_k").alias("size"), F.expr("shiftright(_a, 2 * _k)").alias("at"))).drop("_a", "_k")


def sizes_for(places: int) -> int:
    """Sizes of tiles that so many places need."""
    k = 1
    while FACTOR**k < places and k < 24:
        k += 1
    return k


def placed(rows: DataFrame, by: list[str], order: list[str], cell: str, after: bool = False) -> DataFrame:
    """Every row with where it stands among the cells of its group: `before`, the number of cells up to it, and `last`, the last of them (with `after` also `next`, the first beyond).

    Rows with a `cell` that isn't null are cells, the others ask. Both are in the order of `order` inside of
    a group `by`; a column `tie` puts askers before (-1) or behind (1) cells (0) of the same place, and
    `spread` orders what is left. None of `by` and `order` may be null.

    Rows are dealt to ranges of that whole order, so neither a large group nor a frequent value is one task;
    each range is numbered by itself, and what the ranges before it hold of its first group is added.
    """
    keys = [*by, *order, "tie", "spread"]
    dealt = checkpointed(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    upto = Window.partitionBy("part", *by).orderBy(*keys[len(by) :]).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({"before": F.count(cell).over(upto), "last": F.last(cell, ignorenulls=True).over(upto)})
    group = F.struct(*by)
    own = dealt.groupBy("part", *by).agg(F.count(cell).alias("n"), F.max(F.when(F.col(cell).isNotNull(), F.struct(*keys[len(by) :], cell))).alias("top"), F.min(F.when(F.col(cell).isNotNull(), F.struct(*keys[len(by) :], cell))).alias("low"))
    ends = dealt.groupBy("part").agg(F.min(group).alias("first"), F.max(group).alias("final"))
    carry = own.select("n", "top", F.col("part").alias("other"), group.alias("first")).join(F.broadcast(ends.select("part", "first")), "first").filter("other < part")
    carry = carry.groupBy("part", "first").agg(F.sum("n").alias("more"), F.max("top").alias("top")).select("part", *[F.col("first")[b].alias(b) for b in by], "more", "top")
    out = out.join(F.broadcast(carry), ["part", *by], "left").withColumns({"before": F.col("before") + F.coalesce("more", F.lit(0)), "last": F.coalesce("last", F.col("top")[cell])}).drop("more", "top")
    if after:
        down = Window.partitionBy("part", *by).orderBy(*[F.desc(k) for k in keys[len(by) :]]).rowsBetween(Window.unboundedPreceding, 0)
        carry = own.select("low", F.col("part").alias("other"), group.alias("final")).join(F.broadcast(ends.select("part", "final")), "final").filter("other > part")
        carry = carry.groupBy("part", "final").agg(F.min("low").alias("low")).select("part", *[F.col("final")[b].alias(b) for b in by], "low")
        out = out.withColumn("next", F.last(cell, ignorenulls=True).over(down)).join(F.broadcast(carry), ["part", *by], "left").withColumn("next", F.coalesce("next", F.col("low")[cell])).drop("low")
    return out.drop("part")
