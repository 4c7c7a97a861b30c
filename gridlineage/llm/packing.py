"""Packing of token sequences by deficit round-robin over source queues."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored
from .tokens import encoder, slices, tidied

#: Queues at most, as their token counts are one row each on the driver; the smallest sources beyond share the last one.
QUEUES = 4096
#: Entries of the arrays (turns x queues) that a task works on at once.
ENTRIES = 1 << 19


class Schedule:
    """Where each queue's tokens go in one long row of tokens, which is then cut into sequences.

    Turns of `quantum` tokens are served one after another, each to the queue with the largest deficit: the
    queue of u turns earns u / sum(u) a turn, so the one served next has the smallest (given + 1/2) / u, ties
    to the earlier queue. That order is a fixed one: turn k of a queue comes at (2 k + 1) / u. What has been
    served before it follows from that number alone, so every task starts with the very deficits that
    earlier windows and other tasks have left. A queue's last turn may be short; the next turn follows it at once.
    """

    def __init__(self, tokens: list[int], quantum: int):
        self.tokens, self.quantum = np.array(tokens, np.int64), quantum
        self.units = -(-self.tokens // quantum)
        self.number = np.arange(len(tokens))

    def starts(self, queue: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """The place of the first token of each (queue, turn)."""
        out = np.empty(len(queue), np.int64)
        step = max(1, ENTRIES // len(self.units))
        for lo in range(0, len(queue), step):
            q, k = queue[lo : lo + step, None], 2 * turn[lo : lo + step, None] + 1
            own, others = self.units[q], self.units[None]
            # k * others = whole * own + rest, exactly: products may leave 64 bits, but the rest, taken modulo 2**64, doesn't.
            whole = (k.astype(np.float64) * others / own).astype(np.int64)
            rest = k * others - whole * own
            whole += rest // own
            rest %= own
            # Turns of a queue before this one: odd numbers below k * others / own, or up to it where the tie is won.
            given = (whole + ((rest > 0) | (self.number[None] < q))) // 2
            out[lo : lo + step] = np.minimum(given * self.quantum, self.tokens).sum(1)
        return out

    def pieces(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
        """Rows (document's number, start in it, length, sequence, offset) for runs of tokens of queues, in order.

        A run is cut where a turn or a sequence of `size` tokens ends; what follows on in its sequence is one piece.
        """
        first, last = start // self.quantum, (start + np.maximum(length, 1) - 1) // self.quantum
        turns = last - first + 1
        doc = np.repeat(np.arange(len(queue)), turns)
        turn = np.arange(len(doc)) - np.repeat(np.cumsum(turns) - turns, turns) + first[doc]
        lo = np.maximum(turn * self.quantum, start[doc])
        hi = np.minimum((turn + 1) * self.quantum, (start + length)[doc])
        at = self.starts(queue[doc], turn) + lo - turn * self.quantum
        # Cut at the ends of sequences.
        cuts = (at + hi - lo - 1) // size - at // size + 1
        row = np.repeat(np.arange(len(doc)), cuts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        base = at // size * size
        begin = np.maximum(at[row], base[row] + part * size)
        end = np.minimum((at + hi - lo)[row], base[row] + (part + 1) * size)
        doc, inside = doc[row], (lo - start[doc])[row] + begin - at[row]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (begin[1:] != end[:-1]) | (begin[1:] % size == 0)][: len(doc)]
        heads = np.flatnonzero(new)
        n = np.add.reduceat(end - begin, heads) if len(heads) else np.empty(0, np.int64)
        return np.stack([doc[heads], inside[heads], n, begin[heads] // size, begin[heads] % size], axis=1)


def runs(n: np.ndarray, most: int):
    """Runs of documents of about `most` tokens."""
    ends = np.cumsum(n)
    lo = 0
    while lo < len(n):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield lo, hi
        lo = hi


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, path: str, end: int, source: str = "source") -> DataFrame:
    """One row for each document: part, queue, start (the queue's tokens before it in this part), n, ids."""

    def run(batches):
        tool, part, sums = encoder(path), TaskContext.get().partitionId(), {}
        for b in batches:
            texts, queues, keys = b.column("text").to_pylist(), b.column("queue").to_pylist(), b.column("doc_id")
            for lo, hi in slices(texts):
                ids, starts = tool.encode(texts[lo:hi], end), []
                for q, x in zip(queues[lo:hi], ids, strict=True):
                    starts.append(sums.get(q, 0))
                    sums[q] = starts[-1] + len(x)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo), pa.array([part] * (hi - lo), pa.int64()), pa.array(queues[lo:hi], pa.string()), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() if x.dtype.itemsize != 2 else x.tobytes() for x in ids], pa.binary()), pa.array([x.dtype.itemsize for x in ids], pa.int32())],
                    ["doc_id", "part", "queue", "start", "n", "ids", "width"],
                )

    queue = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", queue.alias("queue")).mapInArrow(run, "doc_id long, part long, queue string, start long, n long, ids binary, width int")


def pack(docs: DataFrame, path: str, end: int = 2, size: int = 4096, quantum: int = 256, source: str = "source") -> DataFrame:
    """All tokens of `docs` in sequences of `size` tokens whose sources have the corpus's proportions.

    Every source is a queue of documents, served in turns of `quantum` tokens, each turn to the queue with
    the largest deficit (see `Schedule`), so a window's mixture is off by less than two turns for each source
    and the difference is carried on. Only the last sequence is short.

    Texts are encoded once, in any order, and stored in the shared folder. A queue's order is that of the
    stored parts; sums for each part and queue, not documents, are cumulated to find where a part starts.
    Documents are never shuffled, so a hot source costs no more than others.

    Null texts are empty documents (the end id alone). A null source is a queue of its own. Of more than QUEUES
    sources, the largest have queues of their own, and all smaller ones share one queue. Documents with
    equal or null ids are packed one by one. An empty table gives an empty result. Returns a row for each piece,
    with columns of PIECES and `ids` (the piece's ids as little-endian unsigned 32-bit integers).
    """
    spark = docs.sparkSession
    kept = stored(encoded(docs, path, end, source), "packing")
    sums = kept.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    largest = sums.groupBy("queue").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "queue").limit(QUEUES + 1).collect()
    if len(largest) > QUEUES:
        # Within a part, the shared queue takes its sources one after another.
        own = F.broadcast(spark.createDataFrame([(r.queue,) for r in largest[: QUEUES - 1]], "queue string"))
        tail = sums.join(own, "queue", "left_anti")
        before = F.sum("n").over(Window.partitionBy("part").orderBy("queue")) - F.col("n")
        tail = stored(tail.select("part", "queue", before.alias("before")), "packing-tail")
        kept = kept.join(small(tail), ["part", "queue"], "left")
        shared = F.col("before").isNotNull()
        kept = kept.select("doc_id", "part", F.when(shared, "t").otherwise(F.col("queue")).alias("queue"), (F.col("start") + F.coalesce("before", F.lit(0))).alias("start"), "n", "ids", "width")
        sums = sums.join(own.withColumn("own", F.lit(True)), "queue", "left").groupBy("part", F.when(F.col("own"), F.col("queue")).otherwise("t").alias("queue")).agg(F.sum("n").alias("n"))
    totals = {r.queue: int(r.n) for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    number = {q: i for i, q in enumerate(names)}
    tokens = [totals[q] for q in names]
    bases = sums.select("part", "queue", (F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("base"))
    bases = stored(bases, "packing-bases")
    placed = kept.join(small(bases), ["part", "queue"]).select("doc_id", "queue", (F.col("start") + F.col("base")).alias("start"), "n", "ids", "width")

    @tidied
    def run(batches):
        plan = Schedule(tokens, quantum)
        for b in batches:
            n = b.column(3).to_numpy()
            for lo, hi in runs(n, 500_000):
                part = b.slice(lo, hi - lo)
                queue = np.array([number[q] for q in part.column(1).to_pylist()], np.int64)
                rows = plan.pieces(queue, part.column(2).to_numpy(), n[lo:hi], size)
                words = [np.frombuffer(x, f"<u{w}").astype("<u4").tobytes() for x, w in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)]
                ids = [words[d][4 * at : 4 * (at + length)] for d, at, length in rows[:, :3].tolist()]
                doc = rows[:, 0]
                crcs = np.array([zlib.crc32(x) for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), *map(pa.array, (rows[:, 1], rows[:, 2], crcs, n[lo:hi][doc], rows[:, 3], rows[:, 4])), pa.array(ids, pa.binary())], schema_names)

    schema = f"{PIECES}, ids binary"
    schema_names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    return placed.mapInArrow(run, schema) if tokens else spark.createDataFrame([], schema)
