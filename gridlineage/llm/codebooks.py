"""Vector codes by product quantisation in integers: codebooks are refined in rounds, and nearest entries found by kd-trees."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored

#: Entries in a leaf of a tree at most.
LEAF = 4
#: Integer components stay below this, so that squared distances of 64 of them fit in a long.
BOUND = 1 << 27
#: Rows whose parts are searched at once.
CHUNK = 4_096


class Tree:
    """A kd-tree over the entries of one codebook (integers, a row each)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        #: Of each node: least and greatest components, its two children (or none), its entries.
        self.nodes: list[tuple] = []
        self.grown(np.arange(len(entries)))

    def grown(self, own: np.ndarray) -> int:
        at, points = len(self.nodes), self.entries[own]
        low, high = points.min(axis=0), points.max(axis=0)
        self.nodes.append(())
        if len(own) <= LEAF or not points.shape[1]:
            self.nodes[at] = (low, high, None, own)
            return at
        axis = int(np.argmax(high - low))
        order = own[np.argsort(points[:, axis], kind="stable")]
        half = len(order) // 2
        self.nodes[at] = (low, high, (self.grown(order[:half]), self.grown(order[half:])), None)
        return at

    def bound(self, node: int, q: np.ndarray) -> np.ndarray:
        """Squared distances from the box of a node's entries: none of them is nearer."""
        low, high = self.nodes[node][:2]
        off = np.maximum(np.maximum(low - q, q - high), 0)
        return (off * off).sum(axis=1)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry to each row of `q`; of entries equally near, the lowest index."""
        at, best = np.full(len(q), len(self.entries)), np.full(len(q), np.iinfo(np.int64).max)
        if len(q):
            self.search(0, q, np.arange(len(q)), at, best)
        return at, best

    def search(self, node: int, q: np.ndarray, rows: np.ndarray, at: np.ndarray, best: np.ndarray) -> None:
        """The nearer child goes first; the other is entered by the rows whose best isn't below its bound, so an equal bound is entered."""
        _, _, children, own = self.nodes[node]
        if own is not None:
            for e in own.tolist():
                off = q[rows] - self.entries[e]
                d = (off * off).sum(axis=1)
                better = (d < best[rows]) | ((d == best[rows]) & (e < at[rows]))
                at[rows[better]], best[rows[better]] = e, d[better]
            return
        a, b = children
        bounds = {c: self.bound(c, q[rows]) for c in children}
        left = bounds[a] <= bounds[b]
        for first, second, mine in ((a, b, left), (b, a, ~left)):
            for child in (first, second):
                near = bounds[child][mine] <= best[rows[mine]]
                if near.any():
                    self.search(child, q, rows[mine][near], at, best)


def whole_numbers(vectors: DataFrame, key: str, vector: str, group: str, scale: int) -> DataFrame:
    """(id, group, v): floor(scale * x) of each component x; rows whose vector is null, or holds null or non-finite components, are dropped."""
    rows = vectors.select(F.col(key).alias("id"), F.col(group).alias("group"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = rows.filter(F.col("v").isNotNull() & finite)
    schema = out.schema

    def run(batches):
        for b in batches:
            v = b.column(2)
            flat = np.floor(v.flatten().to_numpy(zero_copy_only=False) * scale)
            if len(flat) and np.abs(flat).max() >= BOUND:
                raise ValueError(f"components of {BOUND // scale} or more have no code")
            ends = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["id", "group", "v"])

    return out.mapInArrow(run, f"id {schema['id'].dataType.simpleString()}, group {schema['group'].dataType.simpleString()}, v array<int>")


def parts_of(b: pa.RecordBatch, at: int, parts: int):
    """The vectors of a batch in chunks, as (chunk's first row, array of rows x parts x components)."""
    v = b.column(at)
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, parts, -1)
    for start in range(0, b.num_rows, CHUNK):
        yield start, flat[start : start + CHUNK]


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts x entries x components) after one round: every entry becomes the floor of the mean of the parts nearest to it, and one without parts stays.

    Tasks search the trees, which are broadcast, and add up what falls to each entry; a row for each
    entry and component of each task is shuffled, and as many as the codebooks have come to the driver.
    """
    parts, entries, wide = books.shape
    trees = rows.sparkSession.sparkContext.broadcast([Tree(b) for b in books])

    def run(batches):
        sums = np.zeros((parts, entries, wide + 1), np.int64)
        for b in batches:
            for _, chunk in parts_of(b, 0, parts) if b.num_rows else ():
                for p in range(parts):
                    at, _ = trees.value[p].nearest(chunk[:, p])
                    np.add.at(sums[p, :, :wide], at, chunk[:, p])
                    sums[p, :, wide] += np.bincount(at, minlength=entries)
        used = np.flatnonzero(np.repeat(sums[:, :, wide] > 0, wide + 1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums.reshape(-1)[used])], ["slot", "total"])

    got = rows.select("v").mapInArrow(run, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect()
    trees.destroy()
    sums = np.zeros(parts * entries * (wide + 1), np.int64)
    for slot, total in got:
        sums[slot] = total
    sums = sums.reshape(parts, entries, wide + 1)
    count = sums[:, :, wide:]
    return np.where(count > 0, sums[:, :, :wide] // np.maximum(count, 1), books)


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the codebooks (parts x entries x components).

    Components become integers (floor of `scale` times each), vectors are cut into `parts` equal parts, and
    the codebook of each part starts as that part of the vectors with the smallest keys, `entries` of them
    (fewer where there are fewer vectors). After `rounds` of `moved`, parts are assigned once more. Result:
    key, code (an index for each part, two hex digits each), error (sum of squared distances) and
    group_error (the error of all rows of an equal group, nulls together).

    Rows whose vector is null, or holds null or non-finite components, are dropped, as are those of
    another length than most vectors have (of lengths as frequent, the greatest counts): a length that
    `parts` doesn't divide is an error, and so is a component of BOUND / scale or more. A null key comes
    last among the smallest; rows that share a key are taken in the order of their components. Rows that
    repeat stay; tables that are empty, or whose rows are all dropped, give an empty result and no entries.
    Further columns are left out.
    """
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries fit in two hex digits")
    rows = stored(whole_numbers(vectors, key, vector, group, scale), "vectors")
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    wide = lengths[0]["n"] if lengths else 0
    if wide % parts:
        raise ValueError(f"vectors of {wide} components have no {parts} equal parts")
    rows = rows.filter(F.size("v") == wide)
    first = [r["v"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, wide // parts).transpose(1, 0, 2)
    for _ in range(rounds if first else 0):
        books = moved(rows, books)
    trees = rows.sparkSession.sparkContext.broadcast([Tree(b) for b in books] if first else [])

    def run(batches):
        for b in batches:
            codes, errors = np.zeros((b.num_rows, parts), np.uint8), np.zeros(b.num_rows, np.int64)
            for start, chunk in parts_of(b, 2, parts) if b.num_rows else ():
                for p in range(parts):
                    at, d = trees.value[p].nearest(chunk[:, p])
                    codes[start : start + len(chunk), p] = at
                    errors[start : start + len(chunk)] += d
            code = pa.array([c.tobytes().hex() for c in codes], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), code, pa.array(errors)], ["id", "group", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = stored(rows.select("id", "group", "v").mapInArrow(run, f"id {kinds['id']}, group {kinds['group']}, code string, error long"), "codes")
    trees.destroy()
    by_group = stored(coded.groupBy(F.col("group").alias("of")).agg(F.sum("error").alias("group_error")), "errors")
    out = coded.join(small(by_group), coded["group"].eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(key), "code", "error", "group_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal integers with commas, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
