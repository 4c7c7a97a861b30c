"""Exact deduplication by progressive refinement, in DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, checkpointed, small, without

#: Characters of the normalised text that the second level hashes.
PREFIX = 256


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return reduce(lambda c, space: F.replace(c, F.lit(space), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """One row for each row of `docs`: its columns other than the text, and keep_id, group_size, kept.

    With `digests` also text_sha256, the SHA-256 of every normalised text, each worked out once.

    Texts are equal when they are the same without ASCII white space (null counts as empty). Of equal
    texts, the row with the most code points stays, then the smallest key (a null key comes last); of rows
    alike in both, one stays.

    Level 1 counts rows by length. Level 2 counts those of a length that occurs twice by hash of a prefix
    too. Only rows that both leave have their whole content hashed (level 3, SHA-256). Each level counts with
    partial sums before the shuffle. Keys that survive are broadcast if they are at most BROADCAST_ROWS, else joined by
    a shuffle. Input columns with the names of the results are replaced. An empty table gives an empty
    result.
    """
    docs = without(docs, "keep_id", "group_size", "kept", *(["text_sha256"] if digests else []))
    norm = normalised(F.col(text))
    level = docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("row"), F.col(key).alias("id"), F.coalesce(F.length(text), F.lit(0)).alias("points"), norm.alias("norm"))
    level = level.withColumns({"bytes": F.octet_length("norm"), "head": F.xxhash64(F.substring("norm", 1, PREFIX))})
    lengths = checkpointed(level.groupBy("bytes").agg(F.count("*").alias("n")).filter("n > 1").select("bytes"))
    heads = level.join(small(lengths), "bytes", "left_semi").groupBy("bytes", "head").agg(F.count("*").alias("n"))
    heads = checkpointed(heads.filter("n > 1").select("bytes", "head", F.lit(True).alias("again")))
    level = level.join(small(heads), ["bytes", "head"], "left").withColumn("again", F.coalesce("again", F.lit(False)))
    # Rows that survived no level have a name of their own, so that they do not meet in one task.
    whole = F.sha2(F.col("norm").cast("binary"), 256)
    alone = F.concat(F.lit("row"), F.monotonically_increasing_id().cast("string"))
    hashed = {"sha": whole if digests else F.when(F.col("again"), whole)}
    full = level.withColumns(hashed).select("row", "id", "points", "again", "sha", F.monotonically_increasing_id().alias("uid"), alone.alias("alone"))
    full = checkpointed(full.withColumn("digest", F.when(F.col("again"), F.col("sha")).otherwise(F.col("alone"))).drop("alone", *([] if digests else ["sha"])))
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("last"), "id", "uid"))
    groups = checkpointed(full.filter("again").groupBy("digest").agg(F.count("*").alias("n"), best.alias("best")).filter("n > 1"))
    out = full.join(groups, "digest", "left")
    single = F.col("n").isNull()
    more = [F.col("sha").alias("text_sha256")] if digests else []
    return out.select("row.*", F.when(single, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), (single | (F.col("uid") == F.col("best.uid"))).alias("kept"), *more)


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that `exact_groups` keeps, with all their columns.

    Dropped rows are found by key and text hash. Where a key and text repeat as a whole, one row stays.
    """
    print_ = F.struct(F.coalesce(F.col(key).cast("string"), F.lit("")), F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    keyed = docs.select(F.col(key), F.col(text), print_["col2"].alias("h"), print_["col1"].alias("k"))
    groups = checkpointed(exact_groups(keyed, key, text).filter("group_size > 1").select("k", "h", "kept"))
    fate = checkpointed(groups.groupBy("k", "h").agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    gone = fate.filter(~F.col("kept")).select("k", "h")
    repeated = fate.filter("kept and n > 1").select("k", "h")
    marked = docs.select(F.struct("*").alias("row"), print_["col1"].alias("k"), print_["col2"].alias("h"))
    kept = marked.join(small(gone), ["k", "h"], "left_anti")
    if repeated.isEmpty():
        return kept.select("row.*")
    once = kept.join(small(repeated), ["k", "h"], "left_semi").dropDuplicates(["k", "h"])
    return kept.join(small(repeated), ["k", "h"], "left_anti").unionByName(once).select("row.*")
