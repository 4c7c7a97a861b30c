"""How filters interact: every order of the filters is replayed over all documents."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, small, stored, without

#: Filters of one audit at most: their orders are all replayed for each document.
MOST = 6
#: Bits of an order that hold the filter of one step.
WIDE = 8


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails filters A to D: few words, many repeated words, many capitals, marks of code; null counts as empty.

    Words are runs of characters other than ASCII white space, compared with case. An empty text has no
    words: it fails A alone, as no share of nothing is too small or too large.
    """
    words = F.array_remove(F.split(text, f"[{SPACES}]+"), "")
    n, own = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 200, own * 100 < n * 50, capitals * 100 > F.length(text) * 3, text.rlike(r"[#$%&*|]")]


def document_failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, fails): for each row the filters A to E that it fails, as bits from A = 1 to E = 16.

    A to D are those of `text_failures`; E fails where a row with a smaller key has the same text (null
    counts as empty). A null key is neither smaller nor greater than others, so its row never fails E;
    rows that share key and text don't fail by each other. A null part is the part ''. Columns other than
    these three are left out, so their names can't clash. An empty table gives an empty result.

    Texts are read once; their digests (SHA-256) are counted with partial sums before the shuffle, and only
    those that repeat are joined back: broadcast up to BROADCAST_ROWS, else by a shuffle whose hot keys
    adaptive execution splits.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_failures(F.col("text")))), F.lit(0))
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    rows = stored(rows.select("id", "part", bits.alias("fails"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "failures")
    first = stored(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "first")
    later = F.coalesce(F.col("first") < F.col("id"), F.lit(False))
    return rows.join(small(first), "digest", "left").select("id", "part", (F.col("fails") + F.when(later, 16).otherwise(0)).alias("fails"))


def replay(rows: DataFrame, names: str, measures: tuple[str, ...] = ()) -> DataFrame:
    """Outcome of each step of every order of the filters `names` (a letter each), for each part.

    `rows` has part, fails (the filters that a document fails, as bits in the order of `names`) and a
    column of 0 or 1 for each of `measures`. Result: part, filter_order, step (from 1), kept, removed,
    redundant (fails this filter, but was removed earlier), unique_fails (fails this filter only), shapley
    (removed by this filter, summed over all orders), and the sum of each measure over what is removed here.

    Each document meets the whole list of orders, which goes with the plan (MOST! numbers at most), and each
    order is exploded to its steps; the first step whose filter the document fails removes it. The rows
    made this way are summed up in the task that makes them, so what is shuffled is a row for each part,
    order, step and task. Every order and step of a part has a row, zeros included; an empty table has
    no parts and gives an empty result. Repeated rows count again; null bits count as none, null measures as 0.
    """
    if not 1 <= len(names) <= MOST or len(set(names)) < len(names):
        raise ValueError(f"1 to {MOST} different letters expected")
    ways = list(permutations(range(len(names))))
    packed = [sum(1 << (f + WIDE * step) for step, f in enumerate(way)) for way in ways]
    replayed = without(rows, "at", "way", "step", "mask", "gone").withColumn("fails", F.coalesce("fails", F.lit(0)))
    replayed = replayed.select("*", F.posexplode(F.lit(packed).cast("array<long>")).alias("at", "way"))
    gone = F.lit(len(names))
    for step in reversed(range(len(names))):
        gone = F.when(F.shiftright("way", WIDE * step).bitwiseAND(F.col("fails").cast("long")).bitwiseAND((1 << WIDE) - 1) != 0, step).otherwise(gone)
    replayed = replayed.withColumn("gone", gone).select("*", F.explode(F.lit(list(range(len(names))))).alias("step"))
    replayed = replayed.withColumn("mask", F.expr(f"cast(shiftright(way, {WIDE} * step) & {(1 << WIDE) - 1} as int)"))
    here, fails = F.col("gone") == F.col("step"), F.col("fails").bitwiseAND(F.col("mask")) != 0
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = replayed.groupBy("part", "at", "step").agg(
        count(F.col("gone") > F.col("step")).alias("kept"), count(here).alias("removed"), count(fails & (F.col("gone") < F.col("step"))).alias("redundant"), count(F.col("fails") == F.col("mask")).alias("unique_fails"),
        *[F.sum(F.when(here, F.coalesce(m, F.lit(0))).otherwise(0)).alias(m) for m in measures],
    )
    out = out.withColumn("filter_order", F.get(F.lit(["".join(names[f] for f in way) for way in ways]), F.col("at"))).withColumn("step", F.col("step") + 1)
    own = F.expr("substring(filter_order, step, 1)")
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *measures, F.sum("removed").over(Window.partitionBy("part", own)).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """`replay` of filters A to E over all documents, with what is lost of good and of toxic ones.

    good_lost counts removed documents that have a label of quality 1, toxic_lost those with a label of
    toxic 1; of a document's labels one such is enough. Labels of a null key or for no document have no
    effect, and either table may be empty.
    """
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good_lost"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic_lost"))
    marks = stored(marks.filter("good_lost = 1 or toxic_lost = 1"), "marks")
    rows = document_failures(docs, key, text, part).join(small(marks), "id", "left")
    return replay(rows.select("part", "fails", "good_lost", "toxic_lost"), "ABCDE", ("good_lost", "toxic_lost"))
