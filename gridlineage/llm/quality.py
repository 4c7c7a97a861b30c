"""Quality scores: random-indexing word vectors, pooled, and a two-layer network with calibrated probabilities."""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, replace
from itertools import chain, count, groupby, islice
from operator import eq, itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, labelled_sample, learns, shared_dir, stored
from .tokens import slices, tidied

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Dimensions of word vectors, entries of an index vector that aren't 0, neighbours on each side.
DIMS, ENTRIES, NEAR = 48, 6, 2
#: What a neighbour's index vector counts by its distance.
WEIGHTS = (2, 1)
#: How often a word must occur in the corpus to have a vector of its own, and words that are sent with a model at most; the others are joined.
OFTEN, HELD = 5, BROADCAST_ROWS
#: Distinct words that a task sums before it passes them on.
FLUSH = 400_000
#: Runs of words by hash, each of which is summed at once.
BUCKETS = 1024
#: Steps of a unit in which entries of vectors are kept.
STEPS = 63
#: Words whose neighbours are summed at once, and what is added so that no place of such a sum is negative: with that, RUN of them stay below 2**16.
RUN, LIFT, LANES = 4096, 2 * sum(WEIGHTS), np.uint64(0x00FF00FF00FF00FF)
HIDDEN = 32
#: Features of a document: two pools of DIMS, and four for repeated words and length.
WIDTH = 2 * DIMS + 4
#: Entries of what is summed for a document.
STATE = 2 * DIMS + 3
#: Labelled documents of either class that the model is fitted on, at most.
PER_CLASS = 2000


def kind(token: str) -> str:
    """The class that stands for words without a vector of their own."""
    if not token[0].isalnum() and token[0] != "_":
        return f"<{token[0]}{'+' if len(token) > 1 else ''}>"
    case = "X" if token.isupper() else "x" if token.islower() else "Xx" if token[0].isupper() else "0" if token.isdigit() else "mixed"
    return f"<{case}{min(len(token), 12) // 4}>"


def index_vectors(words: list[str]) -> np.ndarray:
    """Fixed sparse vectors of ENTRIES signs, one in each run of DIMS / ENTRIES places, that a hash of the word picks."""
    h = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    h ^= h >> np.uint64(31)
    out, run = np.zeros((len(words), DIMS), np.float32), DIMS // ENTRIES
    for k in range(ENTRIES):
        bits = (h >> np.uint64(10 * k)) & np.uint64(1023)
        place = (bits >> np.uint64(1)) % np.uint64(run)
        out[np.arange(len(words)), k * run + place.astype(np.int64)] = 1 - 2 * (bits & np.uint64(1)).astype(np.float32)
    return out


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def directions(words: list[str], sums: np.ndarray) -> np.ndarray:
    """Vectors of words by the sums of their neighbours' index vectors, in whole numbers of 1 / STEPS."""
    return np.rint((unit(sums) + unit(index_vectors(words))) * STEPS).astype(np.int8)


def word_key(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def numbered(tokens) -> tuple[list[str], np.ndarray]:
    """Distinct tokens as they come, and each token's number among them."""
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, tokens), np.int32)
    return list(number), ids


def longer(m: np.ndarray, used: int, rows: int) -> np.ndarray:
    """The first `used` rows of an array in one of `rows` rows."""
    out = np.zeros((rows, *m.shape[1:]), m.dtype)
    out[:used] = m[:used]
    return out


class Seen:
    """Counts of words and sums of their neighbours' index vectors (nearer ones count more), in whole numbers."""

    def __init__(self):
        self.number = defaultdict(count(1).__next__)
        # Row 0 stands for the gaps between texts. Pages of an array of zeros take memory when they are written first.
        self.index, self.sums, self.count = np.zeros((FLUSH, DIMS), np.int8), np.zeros((FLUSH, DIMS), np.int32), np.zeros(FLUSH, np.int64)

    def add(self, texts: list[str | None]) -> None:
        gap, number = "", self.number
        tokens = [gap] * NEAR
        for t in texts:
            if t:
                tokens += TOKEN.findall(t)
                tokens += [gap] * NEAR
        before = len(number)
        number[gap] = 0
        ids = np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))
        del number[gap], tokens
        at = len(number) + 1
        if at > len(self.index):
            # A quarter more at a time; rows that aren't used yet take no memory.
            self.index, self.sums, self.count = (longer(m, before + 1, at + at // 4) for m in (self.index, self.sums, self.count))
        self.index[before + 1 : at] = index_vectors(list(islice(reversed(number), at - before - 1))[::-1])
        self.count[:at] += np.bincount(ids, minlength=at)
        for lo in range(NEAR, len(ids) - NEAR, RUN):
            hi = min(lo + RUN, len(ids) - NEAR)
            g, size = self.index[ids[lo - NEAR : hi + NEAR]], hi - lo
            near = np.full((size, DIMS), LIFT, np.int8)
            for d, weight in enumerate(WEIGHTS, 1):
                near += weight * (g[NEAR - d : NEAR - d + size] + g[NEAR + d : NEAR + d + size])
            order = np.argsort(ids[lo:hi], kind="stable")
            a = ids[lo:hi][order]
            first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            # Eight places of a byte are a word of 64 bits, so sums of every other byte run in lanes of 16 bits.
            near = near.view(np.uint64)[order]
            total = np.empty((len(first), DIMS), np.int32)
            for k in (0, 1):
                total[:, k::2] = np.add.reduceat((near >> np.uint64(8 * k)) & LANES, first, axis=0).view(np.uint16)
            self.sums[a[first]] += total - LIFT * np.diff(first, append=size)[:, None].astype(np.int32)

    def totals(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        n = len(self.number) + 1
        return list(self.number), self.count[1:n], self.sums[1:n]


def finished(words: list[str], count: np.ndarray, sums: np.ndarray, classes: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words that occur OFTEN times, their counts and vectors; the sums of the others are added to their classes."""
    often = count >= OFTEN
    for i in np.flatnonzero(~often).tolist():
        name = kind(words[i])
        classes[name] = classes.get(name, 0) + sums[i]
    own = [words[i] for i in np.flatnonzero(often).tolist()]
    return own, count[often], directions(own, sums[often])


@dataclass
class Words:
    """Vectors: those of classes first, then those of words in the order of their keys."""

    rows: dict[str, int]
    keys: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(classes: dict[str, np.ndarray], keys: np.ndarray, vectors: np.ndarray) -> Words:
        names = ["<unknown>", *sorted(classes)]
        sums = np.array([np.zeros(DIMS), *(classes[n] for n in names[1:])])
        order = np.argsort(keys)
        return Words({n: i for i, n in enumerate(names)}, keys[order], np.concatenate([directions(names, sums), vectors[order]]))


class Rows(dict):
    """Vector rows of tokens: their own, or that of their class, or row 0."""

    def __init__(self, words: Words, most: int = 300_000):
        super().__init__()
        self.words, self.most = words, most

    def __missing__(self, token: str) -> int:
        if len(self) > self.most:
            self.clear()
        keys, k = self.words.keys, word_key(token)
        at = int(np.searchsorted(keys, k))
        own = at < len(keys) and keys[at] == k
        self[token] = r = len(self.words.rows) + at if own else self.words.rows.get(kind(token), 0)
        return r

    def of(self, tokens: list[str]) -> np.ndarray:
        """The rows of distinct tokens; those that aren't known are looked up at once."""
        new = [t for t in tokens if t not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = tokens
        found = np.array([word_key(t) for t in new], np.int64)
        at = np.searchsorted(self.words.keys, found)
        own = at < len(self.words.keys)
        own[own] = self.words.keys[at[own]] == found[own]
        rows, classes = (len(self.words.rows) + at).tolist(), self.words.rows
        for i in np.flatnonzero(~own).tolist():
            rows[i] = classes.get(kind(new[i]), 0)
        self.update(zip(new, rows, strict=True))
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


@dataclass
class Quality:
    """Words (or their broadcast), the network's weights, the temperature of its output, and the stored table of words beyond those held here."""

    held: Words | Broadcast
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    heat: float = 1.0
    rest: str | None = None

    @property
    def words(self) -> Words:
        return self.held.value if isinstance(self.held, Broadcast) else self.held

    def sent(self, spark: SparkSession) -> Quality:
        """The same with its words broadcast, so that tasks get them once and the driver need not keep them."""
        return self if isinstance(self.held, Broadcast) else replace(self, held=spark.sparkContext.broadcast(self.held))

    def state(self, tokens: list[str], look: Rows) -> np.ndarray:
        """Sums of a document's word vectors and of their squares, how often its words repeat, and its length."""
        return self.states([tokens], look)[0]

    def states(self, docs: list[list[str]], look: Rows) -> np.ndarray:
        """The state of each of some documents."""
        out, size = np.zeros((len(docs), STATE), np.float32), np.array([len(t) for t in docs], np.int64)
        words, ids = numbered(chain.from_iterable(docs))
        if not len(ids):
            return out
        doc, rows, full = np.repeat(np.arange(len(docs)), size), look.of(words), size > 0
        again = np.bincount(doc[1:][(ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])], minlength=len(docs))
        fresh = np.bincount(np.unique(doc * len(words) + ids) // len(words), minlength=len(docs))
        out[full, -3:] = np.column_stack([again[full] / size[full], fresh[full] / size[full], size[full]])
        high = len(self.words.vectors)
        pairs, n = np.unique(doc * high + rows[ids], return_counts=True)
        ends, n = np.searchsorted(pairs, np.arange(len(docs) + 1) * high).tolist(), n.astype(np.float32)
        for i in np.flatnonzero(full).tolist():
            here = slice(ends[i], ends[i + 1])
            v = self.words.vectors[pairs[here] - i * high].astype(np.float32) / STEPS
            out[i, :DIMS], out[i, DIMS : 2 * DIMS] = n[here] @ v, n[here] @ (v * v)
        return out

    def tail(self, tokens: list[str], look: Rows) -> tuple[list[int], list[int], list[int]]:
        """Keys, counts and class rows of the words that have no row of their own here."""
        last = len(self.words.rows)
        count = Counter(t for t in tokens if look[t] < last)
        return [word_key(t) for t in count], list(count.values()), [look[t] for t in count]

    def features(self, states: np.ndarray) -> np.ndarray:
        """Mean and deviation of word vectors, repeated words and length, for each row of states."""
        s = np.asarray(states, np.float64).reshape(-1, STATE)
        again, fresh, size = s[:, -3], s[:, -2], s[:, -1]
        share = 1 / np.maximum(size, 1)[:, None]
        mean = s[:, :DIMS] * share
        deviation = np.sqrt(np.maximum(s[:, DIMS : 2 * DIMS] * share - mean * mean, 0))
        return np.column_stack([mean, deviation, again, fresh, fresh * np.log1p(size), np.log1p(size)])

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.spread @ w1 + b1) @ w2 + b2

    def scores(self, states: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.features(states)) / self.heat, -40, 40)))


def packed(words: list[str], n: np.ndarray, sums: np.ndarray) -> list[tuple[int, bytes]]:
    """(bucket, words with counts and sums, compressed); sums that fit take one byte each."""
    few = (sums.max(axis=1, initial=0) <= 127) & (sums.min(axis=1, initial=0) >= -127)
    at = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words], np.int64)
    order = np.lexsort((~few, at))
    out = []
    for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
        if len(part):
            small_part, large = part[few[part]], part[~few[part]]
            data = ([words[i] for i in part.tolist()], n[part], sums[small_part].astype(np.int8), sums[large])
            out.append((int(at[part[0]]), zlib.compress(pickle.dumps(data), 1)))
    return out


def unpacked(data: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    words, n, few, many = pickle.loads(zlib.decompress(data))
    return words, n, np.concatenate([few.astype(np.int64), many.astype(np.int64)])


def summed(parts, width: int):
    """Totals of runs of equal keys, from parts (keys, rows of numbers) in the order of keys; a run may go on in the next part."""
    last, held = None, np.zeros(width)
    for keys, m in parts:
        if not keys:
            continue
        if last is not None:
            keys, m = [last, *keys], np.concatenate([held[None], m])
        at = np.flatnonzero(np.r_[True, [a != b for a, b in zip(keys, islice(keys, 1, None))]])
        sums = np.add.reduceat(m, at, axis=0)
        last, held = keys[at[-1]], sums[-1]
        yield [keys[i] for i in at[:-1].tolist()], sums[:-1]
    if last is not None:
        yield [last], held[None]


def learned(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, key, n, vector, class): every word that occurs OFTEN times in all of `docs`, and parts of the sums of classes.

    A task sums the index vectors of neighbours for each word it meets; the sums of a word meet by a
    shuffle of compressed buckets, so the vocabulary has no limit. Sums are whole numbers, so their order does not matter.
    """

    @tidied
    def partial(batches):
        seen = Seen()

        def rows():
            out = packed(*seen.totals())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "data"])

        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in slices(texts, 1_000_000):
                seen.add(texts[lo:hi])
                if len(seen.number) > FLUSH:
                    yield from rows()
                    seen = Seen()
        yield from rows()

    @tidied
    def total(batches):
        classes: dict[str, np.ndarray] = {}
        rows = ((k, x) for b in batches for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for _, bucket in groupby(rows, key=itemgetter(0)):
            number: dict[str, int] = {}
            m = np.zeros((1024, DIMS + 1), np.int64)
            for _, data in bucket:
                words, n, sums = unpacked(data)
                ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
                while len(number) > len(m):
                    m = np.concatenate([m, np.zeros_like(m)])
                m[ids] += np.column_stack([n, sums])
            m = m[: len(number)]
            own, n, vectors = finished(list(number), m[:, 0], m[:, 1:], classes)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([word_key(w) for w in own], pa.int64()), pa.array(n, pa.int64()), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array([False] * len(own), pa.bool_())], names)
        some = list(classes)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([0] * len(some), pa.int64()), pa.array([0] * len(some), pa.int64()), pa.array([classes[c].astype("<i8").tobytes() for c in some], pa.binary()), pa.array([True] * len(some), pa.bool_())], names)

    names = ["word", "key", "n", "vector", "class"]
    parts = docs.select(F.col(text).alias("text")).mapInArrow(partial, "bucket int, data binary")
    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(total, "word string, key long, n long, vector binary, class boolean")


def keyed(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of some words of the stored table, on the driver; they come as a few large rows."""

    @tidied
    def run(batches):
        keys, vectors = [], []
        for b in batches:
            keys.append(b.column(0).to_numpy().tobytes())
            vectors += b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(keys)], pa.binary()), pa.array([b"".join(vectors)], pa.binary())], ["keys", "vectors"])

    rows = df.select("key", "vector").mapInArrow(run, "keys binary, vectors binary").collect()
    keys = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(r["keys"], np.int64) for r in rows)])
    return keys, np.concatenate([np.empty((0, DIMS), np.int8), *(np.frombuffer(r.vectors, np.int8).reshape(-1, DIMS) for r in rows)])


def fit(sample: list[tuple[str, int]]) -> Quality:
    """A model from a few texts with labels, in one process: word vectors are those of the sample itself."""
    seen, classes = Seen(), {}
    seen.add([t for t, _ in sample])
    own, _, vectors = finished(*seen.totals(), classes)
    model = untrained(Words.of(classes, np.array([word_key(w) for w in own], np.int64), vectors))
    look = Rows(model.words)
    return trained(model, model.states([TOKEN.findall(t) for t, _ in sample], look), np.array([label for _, label in sample], float))


def untrained(words: Words) -> Quality:
    return Quality(words, np.zeros(WIDTH), np.ones(WIDTH), [np.zeros((WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)])


def trained(model: Quality, states: np.ndarray, y: np.ndarray, share: float | None = None, epochs: int = 40, seed: int = 5) -> Quality:
    """Network and temperature from states of documents and their labels; a fifth is held back to stop and to calibrate.

    share: of label 1 among all labelled documents, to which the sample is weighted; None: as in the sample.
    Labels of one class alone give a constant score on its side of a half, no labels a half.
    """
    model = replace(model)
    x = model.features(states)
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    model.layers = layers
    if len(set(y.tolist())) < 2:
        layers[2][:] = 0
        layers[3][:] = 3.0 * (2 * y.mean() - 1) if len(y) else 0.0
        return model
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-3
    share = y.mean() if share is None else share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    z = (x - model.mean) / model.spread
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    best, kept, t = np.inf, None, 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            t += 1
            h = np.tanh(z[part] @ layers[0] + layers[1])
            gap = (1 / (1 + np.exp(-(h @ layers[2] + layers[3]))) - y[part]) * weight[part] / len(part)
            back = np.outer(gap, layers[2]) * (1 - h * h)
            grads = [z[part].T @ back + 1e-4 * layers[0], back.sum(0), h.T @ gap + 1e-4 * layers[2], np.array([gap.sum()])]
            for p, g, m, v in zip(layers, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        loss = nll(model.logits(x[held]), y[held], weight[held]) if len(held) else 0.0
        if loss < best:
            best, kept = loss, [p.copy() for p in layers]
    model.layers = kept or layers
    if len(held):
        raw = model.logits(x[held])
        model.heat = float(min(np.geomspace(0.25, 8, 60), key=lambda c: nll(raw / c, y[held], weight[held])))
    return model


def nll(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float(np.average(np.logaddexp(0, logits) - y * logits, weights=weight))


def score(docs: DataFrame, model: Quality, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every whole text. Null texts count as empty and score as no words do.

    Nothing but the text enters a score. An empty table gives an empty result.
    """
    model = model.sent(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if model.rest:
        return scored(rows, model, "text", keep=["doc_id"]).select("doc_id", "score")

    @tidied
    def run(batches):
        for b, x in pooled(batches, model, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def good_rows(docs: DataFrame, model: Quality, limit: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores `limit` or more, with all their columns; null texts count as empty."""
    model, at = model.sent(docs.sparkSession), docs.columns.index(text)
    if model.rest:
        return scored(docs, model, text, keep=docs.columns).filter(F.col("score") >= limit).select(*docs.columns)

    @tidied
    def run(batches):
        for b, x in pooled(batches, model, at):
            yield b.filter(pa.array(model.scores(x) >= limit, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def pooled(batches, model: Quality, at: int):
    """Slices of the batches with the state of each text in column `at`, by the words that go with the model."""
    look = Rows(model.words)
    try:
        for b in batches:
            texts = b.column(at).to_pylist()
            for lo, hi in slices(texts, 1_500_000):
                yield b.slice(lo, hi - lo), model.states([TOKEN.findall(t) if t else [] for t in texts[lo:hi]], look)
    finally:
        # Workers are used again by other operators, which need the room; the next task reads the words anew.
        if isinstance(model.held, Broadcast):
            vars(model.held).pop("_value", None)


def scored(docs: DataFrame, model: Quality, text: str, keep: list[str]) -> DataFrame:
    """Columns `keep` of `docs` with `score`, for a vocabulary that is more than may be broadcast."""

    def run(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column(b.num_columns - 1).to_pylist()), np.float64).reshape(-1, STATE)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.scores(x), pa.float64())], [*keep, "score"])

    states = states_of(docs, model, text, keep)
    return states.mapInArrow(run, T.StructType([*states.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def states_of(docs: DataFrame, model: Quality, text: str, keep: list[str]) -> DataFrame:
    """Columns `keep` of `docs` with `quality_state`, the state of each text by all words, as 64-bit numbers.

    The words of the model are summed where the text is; each other word counts as its class first and is
    sent, with its count, to the stored table, whose vectors come back as differences to be added.
    """
    at, places = docs.columns.index(text), [docs.columns.index(c) for c in keep]

    @tidied
    def plain(batches):
        for b, x in pooled(batches, model, at):
            yield pa.RecordBatch.from_arrays([*(b.column(p) for p in places), pa.array([s.tobytes() for s in x.astype(np.float64)], pa.binary())], [*keep, "quality_state"])

    if not model.rest:
        return docs.mapInArrow(plain, T.StructType([*(docs.schema[p] for p in places), T.StructField("quality_state", T.BinaryType())]))

    @tidied
    def states(batches):
        part, row = TaskContext.get().partitionId() << 40, 0
        look = Rows(model.words)
        for b in batches:
            texts = b.column(at).to_pylist()
            for lo, hi in slices(texts, 1_500_000):
                tokens = [TOKEN.findall(t) if t else [] for t in texts[lo:hi]]
                own = model.states(tokens, look)
                tails = [model.tail(t, look) for t in tokens]
                columns = [pa.array(range(part + row, part + row + hi - lo), pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())]
                columns += [pa.array([t[k] for t in tails], pa.list_(kind_of)) for k, kind_of in enumerate((pa.int64(), pa.int64(), pa.int32()))]
                row += hi - lo
                yield pa.RecordBatch.from_arrays([*columns, *(b.column(p).slice(lo, hi - lo) for p in places)], names)

    @tidied
    def totals(batches):
        vectors = model.words.vectors

        def parts():
            for b in batches:
                state, n, of, vector = (b.column(c).to_pylist() for c in range(1, 5))
                m = np.zeros((len(state), STATE), np.float64)
                whole = np.array([s is not None for s in state], bool)
                m[whole] = np.frombuffer(b"".join([s for s in state if s is not None]), np.float32).reshape(-1, STATE)
                if not whole.all():
                    v = np.frombuffer(b"".join([x for x in vector if x is not None]), np.int8).reshape(-1, DIMS) / STEPS
                    c = vectors[[x for x in of if x is not None]] / STEPS
                    times = np.array([x for x in n if x is not None], float)[:, None]
                    m[~whole, : 2 * DIMS] = np.concatenate([times * (v - c), times * (v * v - c * c)], axis=1)
                yield b.column(0).to_pylist(), m

        for ids, m in summed(parts(), STATE):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in m], pa.binary())], ["quality_row", "quality_state"])

    names = ["quality_row", "quality_own", "quality_keys", "quality_counts", "quality_classes", *keep]
    schema = T.StructType([*T._parse_datatype_string("quality_row long, quality_own binary, quality_keys array<long>, quality_counts array<long>, quality_classes array<int>").fields, *(docs.schema[p] for p in places)])
    kept = stored(docs.mapInArrow(states, schema), "quality-states")
    tails = kept.select("quality_row", F.explode(F.arrays_zip("quality_keys", "quality_counts", "quality_classes")).alias("t")).select("quality_row", F.col("t.quality_keys").alias("key"), F.col("t.quality_counts").alias("n"), F.col("t.quality_classes").alias("of"))
    rest = docs.sparkSession.read.parquet(model.rest).filter("not class").select("key", "vector")
    found = tails.join(rest, "key").select("quality_row", F.lit(None).cast("binary").alias("state"), "n", "of", "vector")
    own = kept.select("quality_row", F.col("quality_own").alias("state"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("int").alias("of"), F.lit(None).cast("binary").alias("vector"))
    sums = own.unionByName(found).repartition("quality_row").sortWithinPartitions("quality_row").mapInArrow(totals, "quality_row long, quality_state binary")
    return kept.select("quality_row", *keep).join(sums, "quality_row").select(*keep, "quality_state")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, held: int = HELD) -> Quality:
    """Word vectors from all of `docs`, and a network from at most `per_class` labelled documents of either class (and SAMPLE_BYTES of them), none of them held out.

    Up to `held` of the most frequent words go with the model; the others stay in the stored table. Of the
    sample only the states, of STATE numbers each, come to the driver.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/quality-words-{uuid.uuid4().hex}"
    learned(docs).write.parquet(path)
    table = spark.read.parquet(path)
    classes: dict[str, np.ndarray] = {}
    for r in table.filter("class").select("word", "vector").collect():
        classes[r.word] = classes.get(r.word, 0) + np.frombuffer(r.vector, "<i8")
    own = table.filter("not class")
    least, size = OFTEN, 0
    for r in own.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        size += r.words
        if size > held:
            least = r.n + 1
            break
    model = untrained(Words.of(classes, *keyed(own.filter(F.col("n") >= least)))).sent(spark)
    model.rest = path if size > held else None
    sample = states_of(labelled_sample(docs, labels, "quality", per_class), model, "text", keep=["doc_id", "label"]).collect()
    sample.sort(key=lambda r: r.doc_id)
    known = labels.filter(learns(F.col("doc_id")) & F.col("quality").isin(0, 1))
    states = np.frombuffer(b"".join([r.quality_state for r in sample]), np.float64)
    return trained(model, states, np.array([r.label for r in sample], float), known.agg(F.avg("quality")).first()[0])
