"""Sharding by proportional stratified interleaving, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, without


def interleave(docs: DataFrame, n_shards: int = 16, strata: str = "source", key: str = "doc_id", ties: tuple[str, ...] = (), seed: int = 17) -> DataFrame:
    """`docs` with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in each shard).

    Rows are shuffled by a seeded hash of `key` inside each stratum and ranked; a row of rank r among n
    stands at (2r + 1) / 2n of the whole, and the whole, sorted by that, is cut into `n_shards` runs.
    So every shard has the mixture of strata that the corpus has, and shards differ by one row at most.

    Both rankings are exact but never sort a stratum or the corpus in one task: rows are dealt to hash
    ranges (then fraction ranges), ranked there, and raised by the count of the ranges before. The second
    counts follow from the sizes of the strata alone. The number of ranges is the number of shuffle
    partitions, and the result doesn't depend on it.

    A null stratum is a stratum of its own; a null key hashes as an empty one. Rows with equal keys are
    ordered by `ties`; rows equal in these too are interchangeable. Columns `shard` and `slot` of the
    input are replaced. An empty table gives an empty result.
    """
    ranges = partitions(docs.sparkSession)
    total = docs.count()
    cuts = 4 * ranges
    docs = without(docs, "shard", "slot")
    stratum = F.coalesce(F.concat(F.lit("s"), F.col(strata).cast("string")), F.lit("n"))
    mixed = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    rows = docs.select(F.struct("*").alias("row"), stratum.alias("stratum"), mixed.alias("mixed"))
    rows = rows.withColumn("range", F.shiftright(F.conv(F.substring("mixed", 1, 8), 16, 10).cast("long") * ranges, 32).cast("int"))
    order = [F.col("mixed"), F.col(f"row.{key}"), *[F.col(f"row.{c}") for c in ties]]

    counts = rows.groupBy("stratum", "range").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("stratum")
    before = counts.select("stratum", "range", F.sum("n").over(whole).alias("size"), (F.sum("n").over(whole.orderBy("range")) - F.col("n")).alias("base"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("stratum", "range").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["stratum", "range"]).withColumn("rank", F.col("rank") + F.col("base"))
    ranked = ranked.withColumn("cut", F.expr(f"cast(((2 * rank + 1) * {cuts}) div (2 * size) as int)"))

    sizes = counts.groupBy("stratum").agg(F.sum("n").alias("size"))
    below = lambda c: f"((2 * size * {c} + {cuts} - 1) div {2 * cuts})"  # noqa: E731  rows of the stratum before cut c
    filled = sizes.select("size", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("cut"))
    filled = filled.groupBy("cut").agg(F.expr(f"sum({below('(cut + 1)')} - {below('cut')})").alias("n"))
    starts = filled.select("cut", (F.sum("n").over(Window.orderBy("cut")) - F.col("n")).alias("start"))

    within = Window.partitionBy("cut").orderBy(F.expr("cast(2 * rank + 1 as double) / cast(2 * size as double)"), "stratum", *order)
    placed = ranked.withColumn("place", F.row_number().over(within) - 1).join(F.broadcast(starts), "cut")
    placed = placed.withColumn("place", F.col("place") + F.col("start"))
    placed = placed.withColumn("shard", F.expr(f"cast((place * {n_shards}) div {max(total, 1)} as int)"))
    return placed.select("row.*", "shard", F.expr(f"place - ((shard * {total}L + {n_shards - 1}) div {n_shards})").alias("slot"))
