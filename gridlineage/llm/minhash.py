"""Near-duplicate groups by b-bit MinHash, band buckets and a check on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small, stored
from .tokens import slices, tidied

#: Bands of rows: a link of similarity 0.8 shares no band in 3 of a million cases, one of 0.85 in 7 of a billion.
BANDS, ROWS = 32, 5
#: Minima in a signature (the bands take the first). Of each the lowest bit is kept, in words of 64.
MINIMA = 1024
WORDS = MINIMA // 64
#: Pairs whose estimate is this much below the threshold aren't compared: 4.2 standard deviations at 0.8, 1 link in 100,000.
SLACK = 0.08
#: Rounds in which every bucket compares its members with one of them, before pairs across components are left.
ROUNDS = 2
#: Members of a block of an open bucket, pairs of a pivot or of a label that go to one cell, bytes of the sets that a cell holds.
BLOCK, STAR, CELL = 8_192, 20_000, 64_000_000
#: Edges that a task contracts at once.
CHUNK = 500_000
#: Odd multipliers and the bases of the hashes.
BASE, SPREAD = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
WORD_BREAKS = np.zeros(256, bool)
WORD_BREAKS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on unsigned 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(SPREAD[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(SPREAD[1])
    return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int = 1) -> np.ndarray:
    return (mixed(np.arange(seed, seed + n, dtype=np.uint64) * np.uint64(BASE)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 20)
        inverse = np.uint64(pow(BASE, -1, 1 << 64))
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (np.uint64(BASE), inverse)]
    return _powers[0], _powers[1]


def shingles(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles.

    A text's words are runs of characters other than ASCII white space, with A-Z lower-cased; a shingle is
    `width` words in a row, or all words of a text that has fewer. Words are hashed as polynomials in
    BASE, for the whole batch at once, by differences of running sums.
    """
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = LOWER[np.frombuffer(b" ".join([*raw, b""]) or b" ", np.uint8)]
    gap = WORD_BREAKS[data]
    begins = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    ends = np.flatnonzero(gap & np.r_[False, ~gap[:-1]])
    up, down = powers(len(data) + 1)
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])]
    words = mixed((sums[ends] - sums[begins]) * down[begins])
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    counts = np.diff(np.searchsorted(begins, bounds))
    turn = [np.uint64(pow(SPREAD[1], k, 1 << 64)) for k in range(1, width + 1)]
    rolled = sum(words[k : len(words) - width + 1 + k] * turn[k] for k in range(width)) if len(words) >= width else np.empty(0, np.uint64)
    rolled, out, at = mixed(rolled), [], 0
    for n in counts.tolist():
        if n >= width:
            x = np.sort(rolled[at : at + n - width + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif n:
            short = (words[at : at + n] * np.array(turn[:n], np.uint64)).sum(keepdims=True, dtype=np.uint64)
            out.append(mixed(short + np.array([BASE + n], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def minima(sets: list[np.ndarray], n: int, mult: np.ndarray) -> np.ndarray:
    """For each set (none empty) the smallest of its hashes under each of n multiplicative permutations."""
    out = np.empty((len(sets), n), np.uint32)
    lo = 0
    while lo < len(sets):
        hi, size = lo, 0
        while hi < len(sets) and (hi == lo or size + len(sets[hi]) <= 30_000):
            size += len(sets[hi])
            hi += 1
        flat = (np.concatenate(sets[lo:hi]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[lo : hi - 1])])
        scratch = np.empty_like(flat)
        for k in range(n):
            np.multiply(flat, mult[k], out=scratch)
            out[lo:hi, k] = np.minimum.reduceat(scratch, starts)
        lo = hi
    return out


def signatures(mins: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, and the low bits of the minima in 64-bit words."""
    m = mixed(mins.astype(np.uint64))
    turn = np.array([pow(SPREAD[0], k, 1 << 64) for k in range(1, rows + 1)], np.uint64)
    keys = mixed((m[:, : bands * rows].reshape(len(m), bands, rows) * turn).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(BASE))
    low = (m & np.uint64(1)).astype(np.uint8)
    return keys.view(np.int64), np.packbits(low, axis=1).view("<i8")


def signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n, same, sig, keys) of every document; `same` is a fingerprint of its shingle set, null for an empty one."""
    schema = "id long, n long, same binary, sig array<long>, keys array<long>"

    @tidied
    def run(batches):
        mult = multipliers(MINIMA)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts, 800_000):
                sets = shingles(texts[lo:hi], width)
                full = [s for s in sets if len(s)]
                keys, sig = signatures(minima(full, MINIMA, mult), bands, rows) if full else (np.empty((0, bands), np.int64), np.empty((0, WORDS), np.int64))
                place = np.cumsum([bool(len(s)) for s in sets]) - 1
                has = [bool(len(s)) for s in sets]
                lists = lambda a: pa.array([a[p] if h else None for p, h in zip(place, has, strict=True)], pa.list_(pa.int64()))
                same = pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), same, lists(sig), lists(keys)], ["id", "n", "same", "sig", "keys"])

    return docs.mapInArrow(run, schema)


def fingerprint(s: np.ndarray) -> bytes:
    """Sum and sum of mixed hashes, both modulo 2**64, and the size: 128 bits for the set."""
    return np.array([s.sum(dtype=np.uint64), mixed(s ^ np.uint64(BASE)).sum(dtype=np.uint64), len(s)], np.uint64).tobytes()


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """(same, set) of the documents: fingerprint and sorted shingle hashes, once for each task and distinct set."""

    @tidied
    def run(batches):
        given: set[bytes] = set()
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts, 1_000_000):
                new = {fingerprint(s): s for s in shingles(texts[lo:hi], width) if len(s)}
                new = {k: s for k, s in new.items() if k not in given}
                if len(given) > 100_000:
                    given.clear()
                given.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array([s.tobytes() for s in new.values()], pa.binary())], ["same", "set"])

    return docs.mapInArrow(run, "same binary, set binary")


def segments(batches, keys: list[str]):
    """(whether a cell begins, rows) for each run of rows of one cell, in batches that are sorted by `keys`."""
    last = None
    for b in batches:
        if b.num_rows:
            columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            at = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]).tolist()
            for lo, hi in zip(at, [*at[1:], b.num_rows], strict=True):
                now = [c[lo] for c in columns]
                yield now != last, b.slice(lo, hi - lo)
                last = now


class Block:
    """Members of an open bucket as arrays."""

    def __init__(self, rows: pa.RecordBatch, bands: int):
        self.cls, self.comp, self.n = (rows.column(c).to_numpy() for c in ("cls", "comp", "n"))
        flat = lambda c: rows.column(c).flatten().to_numpy()
        self.sig, self.keys = flat("sig").view(np.uint64).reshape(-1, WORDS), flat("keys").reshape(-1, bands)

    def pairs(self, other: Block, most: int, band: int, percent: int):
        """Places (here, there) of the candidates among outsiders here and members there, each in the first band they share."""
        limit = int((1 - percent / 100 + SLACK) * MINIMA / 2)
        step = max(1, (1 << 18) // max(1, len(other.cls)))
        for lo in range(0, len(self.cls), step):
            here = slice(lo, lo + step)
            apart = np.bitwise_count(self.sig[here, None] ^ other.sig[None]).sum(2, dtype=np.int32)
            n, m = self.n[here, None], other.n[None]
            ok = (apart <= limit) & (self.comp[here, None] != other.comp[None]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            ok &= (other.comp == most)[None] | (self.cls[here, None] > other.cls[None])
            i, j = np.nonzero(ok)
            i += lo
            for k in range(0, len(i), 1 << 16):
                x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                first = (self.keys[x] == other.keys[y]).argmax(1) == band
                yield x[first], y[first]


def across(left: DataFrame, bodies: DataFrame, percent: int, bands: int) -> DataFrame:
    """(label, cls, comp, n, xs): candidate pairs across the components of open buckets, as the members y with all their x.

    A pair across components has a side x that is not in the bucket's largest component, the label. A bucket
    is cut into blocks of BLOCK members; every block of outsiders meets every block of members in a cell,
    where signatures are compared as matrices. What is shuffled and returned grows with members, not with
    pairs: a row without `xs` for each x that is in a pair, and one with `xs` for each y of a cell.
    """
    own = lambda n: F.pmod(F.xxhash64("cls"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = left.withColumn("nx", F.ceil(F.col("outside") / BLOCK)).withColumn("ny", F.ceil(F.col("k") / BLOCK))
    x = rows.filter("comp <> most").select("bucket", "band", "most", "cls", "comp", own("nx").alias("i"), every("ny").alias("j"), F.lit(0).alias("kind"))
    y = rows.select("bucket", "band", "most", "cls", "comp", own("ny").alias("j"), every("nx").alias("i"), F.lit(1).alias("kind"))
    rows = x.unionByName(y).join(bodies, "cls").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "kind")
    names = ["label", "cls", "comp", "n", "xs"]

    @tidied
    def run(batches):
        out: list[list] = [[] for _ in names]

        def add(*row):
            for c, v in zip(out, row, strict=True):
                c.append(v)

        def batch():
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.list_(pa.int64()))], names)

        held, parts, told = None, [], set()
        for begins, rows in segments(batches, ["bucket", "i", "j"]):
            if begins:
                held, parts, told = None, [], set()
            kind = rows.column("kind").to_numpy()
            cut = int(np.searchsorted(kind, 1))
            if cut:
                parts.append(rows.slice(0, cut))
            if cut == len(kind):
                continue
            if held is None:
                held = Block(pa.Table.from_batches(parts).combine_chunks().to_batches()[0], bands)
            most, band = rows.column("most")[0].as_py(), rows.column("band")[0].as_py()
            there = Block(rows.slice(cut), bands)
            for i, j in held.pairs(there, most, band, percent):
                for x in np.unique(i).tolist():
                    if x not in told:
                        told.add(x)
                        add(most, held.cls[x], held.comp[x], held.n[x], None)
                order = np.argsort(j, kind="stable")
                i, j = i[order], j[order]
                at = np.flatnonzero(np.r_[True, j[1:] != j[:-1]][: len(j)])
                for y, xs in zip(j[at].tolist(), np.split(held.cls[i], at[1:]), strict=False):
                    add(most, there.cls[y], there.comp[y], there.n[y], xs)
                if sum(len(xs) for xs in out[4] if xs is not None) + len(out[0]) > 50_000:
                    yield batch()
                    out = [[] for _ in names]
        yield batch()

    return rows.mapInArrow(run, "label long, cls long, comp long, n long, xs array<long>")


def dealt(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held, asks) for `confirmed`, from what `across` returns.

    The x of a label share a cell unless their sets have more than CELL bytes or their pairs are more than
    STAR; then they are dealt over several by a hash, and an y goes to those that hold one of its x.
    """
    held = found.filter("xs is null").select("label", "cls", "comp", "n").distinct()
    asks = found.filter("xs is not null")
    bytes_ = held.groupBy("label").agg(F.ceil(F.sum(F.col("n") * 8 + 100) / CELL).alias("a"))
    pairs = asks.groupBy("label").agg(F.ceil(F.sum(F.size("xs")) / STAR).alias("b"))
    large = checkpointed(bytes_.join(pairs, "label").select("label", F.greatest("a", "b").alias("parts")).filter("parts > 1"))
    place = lambda x: F.pmod(F.xxhash64(x), F.col("parts"))
    if large.isEmpty():
        held, asks = (d.withColumn("part", F.lit(0).cast("long")) for d in (held, asks))
    else:
        parts = small(large)
        held, asks = (d.join(parts, "label", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))) for d in (held, asks))
        held = held.withColumn("part", place(F.col("cls")))
        asks = asks.withColumn("part", F.explode(F.array_distinct(F.transform("xs", place)))).withColumn("xs", F.filter("xs", lambda x: place(x) == F.col("part")))
    asks = asks.groupBy("label", "part", "cls", "comp").agg(F.flatten(F.collect_list("xs")).alias("xs"))
    return held.select("label", "part", "cls", "comp"), asks


def confirmed(held: DataFrame, asks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs with 100 * intersection >= percent * union that connect what the pairs of their cell connect.

    held: (label, part, cls, comp) of the x of each cell; asks: the same of its y, with `xs`. A cell holds
    the sets of its x, which `part` bounds, and takes its y one at a time; a pair whose components the cell
    has joined already is passed over.
    """
    rows = held.withColumn("xs", F.lit(None).cast("array<long>")).unionByName(asks).withColumn("kind", F.col("xs").isNotNull().cast("int")).join(sets, "cls")
    rows = rows.repartition("label", "part").sortWithinPartitions("label", "part", "kind", "cls")

    @tidied
    def run(batches):
        a: list[int] = []
        b: list[int] = []
        cell = Cell(percent)
        for begins, rows in segments(batches, ["label", "part"]):
            if begins:
                cell = Cell(percent)
            for cls, comp, xs, data in zip(*(rows.column(c).to_pylist() for c in ("cls", "comp", "xs")), rows.column("set"), strict=True):
                s = np.frombuffer(data.as_buffer(), np.uint64)
                if xs is None:
                    cell.hold(cls, comp, s)
                else:
                    for x in cell.links(comp, s, xs):
                        a.append(x)
                        b.append(cls)
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


class Cell:
    """Full sets to compare with, and what is known to be connected."""

    def __init__(self, percent: int):
        self.percent = percent
        self.sets: dict[int, np.ndarray] = {}
        self.comp: dict[int, int] = {}
        self.up: dict[int, int] = {}
        self.codes: np.ndarray | None = None

    def hold(self, cls: int, comp: int, s: np.ndarray) -> None:
        self.sets[cls], self.comp[cls] = s.copy(), comp

    def root(self, c: int) -> int:
        while (p := self.up.get(c, c)) != c:
            self.up[c] = c = self.up.get(p, p)
        return c

    def links(self, comp: int, s: np.ndarray, xs: list[int]):
        """Those of the held sets `xs` that are linked with `s` and not connected with it yet."""
        if self.codes is None:
            # Hashes become places in one array, in which a set can be marked.
            names, sizes = list(self.sets), [len(v) for v in self.sets.values()]
            self.codes, places = np.unique(np.concatenate(list(self.sets.values())), return_inverse=True)
            self.sets = dict(zip(names, np.split(places, np.cumsum(sizes)[:-1]), strict=True))
            self.marks = np.zeros(len(self.codes), bool)
        xs = [x for x in set(xs) if x in self.sets and self.root(self.comp[x]) != self.root(comp)]
        if not xs:
            return
        at = np.minimum(np.searchsorted(self.codes, s), len(self.codes) - 1)
        at = at[self.codes[at] == s]
        self.marks[at] = True
        for lo in range(0, len(xs), 2_000):
            some = [self.sets[x] for x in xs[lo : lo + 2_000]]
            sizes = np.array([len(v) for v in some])
            both = np.add.reduceat(self.marks[np.concatenate(some)], np.cumsum(sizes) - sizes, dtype=np.int64)
            for k in np.flatnonzero(100 * both >= self.percent * (sizes + len(s) - both)).tolist():
                x = xs[lo + k]
                p, q = self.root(self.comp[x]), self.root(comp)
                if p != q:
                    self.up[max(p, q)] = min(p, q)
                    yield x
        self.marks[at] = False


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id of the edges but the smallest of its component, with that smallest id."""
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(ids))
    while True:
        p, q = label[x], label[y]
        if (p == q).all():
            break
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    own = label == np.arange(len(ids))
    return ids[~own], ids[label[~own]]


def stars(edges: DataFrame, chunk: int) -> DataFrame:
    """Edges (a, b), a > b, that connect what `edges` connect; each task hangs ids on the smallest they reach by `chunk` of its edges."""

    @tidied
    def run(batches):
        a, b, n = [], [], 0
        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            n += batch.num_rows
            if n >= chunk:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in forest(np.concatenate(a), np.concatenate(b))], ["a", "b"])
                a, b, n = [], [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in forest(np.concatenate(a), np.concatenate(b))], ["a", "b"])

    return edges.coalesce(max(1, edges.count() // chunk)).mapInArrow(run, "a long, b long")


def both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def rooted(edges: DataFrame) -> DataFrame:
    """(a, up): every id of the edges with the root it reaches by going to its smallest neighbour again and again.

    Of two ids that are each other's smallest neighbour, the smaller is the root; no longer circle is
    possible. Each root gathers at least one other id. Pointers are doubled, so depth d takes log d steps.
    """
    up = checkpointed(both(edges).groupBy("a").agg(F.min("b").alias("up")))
    again = up.select(F.col("a").alias("up"), F.col("up").alias("upper"))
    up = checkpointed(up.join(again, "up").select("a", F.when((F.col("upper") == F.col("a")) & (F.col("a") < F.col("up")), F.col("a")).otherwise(F.col("up")).alias("up")))
    while True:
        again = up.select(F.col("a").alias("up"), F.col("up").alias("upper"))
        more = checkpointed(up.join(again, "up").select("a", F.col("upper").alias("up"), (F.col("upper") != F.col("up")).alias("moved")))
        up = more.select("a", "up")
        if more.filter("moved").isEmpty():
            return up


def contractions(edges: DataFrame, chunk: int = CHUNK):
    """Pointers (a, up) of one round after another, until no edge is left; a round leaves half of the ids that have edges at most."""
    edges = checkpointed(edges.filter("a <> b").select("a", "b"))
    edges = checkpointed(stars(edges, chunk))
    while not edges.isEmpty():
        ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty():
            # Every id hangs on one root and no root hangs on another.
            yield edges.select("a", F.col("b").alias("up"))
            return
        up = rooted(edges)
        yield up
        moved = edges.join(up, "a").select(F.col("up").alias("a"), "b").join(up.withColumnRenamed("a", "b").withColumnRenamed("up", "to"), "b")
        edges = checkpointed(moved.select("a", F.col("to").alias("b")).filter("a <> b").distinct())
        edges = checkpointed(stars(edges, chunk))


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(id, comp): the smallest id that can be reached, for every id with an edge.

    Tasks contract their own edges first; then rounds of `rooted` contract the rest, at most log n of them.
    An edge from an id to itself gives that id alone. Repeated edges and an empty table are fine.
    """
    labels = both(edges).select(F.col("a").alias("id")).distinct().withColumn("comp", F.col("id"))
    for up in contractions(edges, chunk):
        labels = checkpointed(labels.join(up.withColumnRenamed("a", "comp"), "comp", "left").select("id", F.coalesce("up", "comp").alias("comp")))
    low = labels.groupBy("comp").agg(F.min("id").alias("low"))
    return checkpointed(labels.join(low, "comp").select("id", F.col("low").alias("comp")))


def estimate(minima: int) -> Column:
    """Similarity by bit counts of two signatures, in columns x_s0... and y_s0...; unlike minima agree in the one bit by chance half the time."""
    apart = " + ".join(f"bit_count(x_s{w} ^ y_s{w})" for w in range(minima // 64))
    return F.expr(f"1 - 2 * ({apart}) / {float(minima)}")


def side(bodies: DataFrame, prefix: str) -> DataFrame:
    """A body's columns renamed for one side of a pair; the signature's words as columns keep comparisons in generated code."""
    return bodies.select(F.col("cls").alias(prefix), F.col("n").alias(f"{prefix}_n"), *[F.col("sig")[i].alias(f"{prefix}_s{i}") for i in range(WORDS)])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each document.

    Documents are linked if 100 * intersection >= percent * union of their sets of `width`-word shingles;
    component_id is the smallest id reachable by links, and kept marks the document that has it. Texts
    without words and null texts are linked with nothing. Rows that share an id but not a text are nodes of
    their own. Rows without an id are in the component of their equals, or in none. An empty table gives an
    empty result.

    1. Every text is read once: shingles, minima, band keys and the low bits of the minima.
    2. Documents with equal sets are one class, and only classes are compared.
    3. In ROUNDS rounds, each band bucket that holds several components compares its members with one of
       them: by the bit estimate first, then on full sets. Links contract to components, so a bucket of k
       near copies costs about k comparisons.
    4. Members of buckets that still hold several components are compared in blocks (`across`), each pair
       in the first bucket that it shares, so no candidate is left out.
    """
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    base = stored(signed(source, width, bands, rows), "minhash")
    classes = base.filter("same is not null and id is not null").groupBy("same").agg(F.min("id").alias("low"), F.first(F.struct("n", "sig", "keys")).alias("body"))
    reps = checkpointed(classes.select(F.monotonically_increasing_id().alias("cls"), "same", "low", "body.*"))
    members = reps.select("cls", F.posexplode("keys").alias("band", "bucket"))
    several = checkpointed(members.groupBy("bucket").agg(F.count("*").alias("k")).filter("k > 1"))
    shared = checkpointed(members.join(several, "bucket").select("bucket", "band", "k", "cls"))
    bodies = reps.select("cls", "n", "sig")
    near = F.expr(f"100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n)") & (estimate(MINIMA) >= percent / 100 - SLACK)

    def linked(held: DataFrame, asks: DataFrame) -> DataFrame:
        wanted = held.select("cls").unionByName(asks.select("cls")).distinct()
        wanted = checkpointed(wanted.join(reps.select("cls", "same", "low"), "cls"))
        ids = small(wanted.select(F.col("low").alias("id")).distinct(), wanted.count())
        sets = sets_of(source.join(ids, "id", "left_semi"), width).join(small(wanted.select("cls", "same")), "same").select("cls", "set")
        return checkpointed(confirmed(held, asks, sets, percent))

    def labelled(comps: DataFrame | None) -> DataFrame:
        return shared.withColumn("comp", F.col("cls")) if comps is None else shared.join(comps.withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))

    links, comps, done = None, None, False
    for turn in range(ROUNDS):
        now = labelled(comps)
        # The draw depends on the class alone, so that the buckets of one group draw few different ones.
        drawn = F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("at"), "cls", "comp"))
        pivots = now.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), drawn.alias("pivot")).filter("low < high")
        pivots = checkpointed(pivots.select("bucket", F.col("pivot.cls").alias("x"), F.col("pivot.comp").alias("x_comp")))
        if pivots.isEmpty():
            done = True
            break
        pairs = now.join(pivots, "bucket").filter("comp <> x_comp").select("x", F.col("cls").alias("y"), "x_comp", F.col("comp").alias("y_comp")).distinct()
        pairs = checkpointed(pairs.join(side(bodies, "y"), "y").join(side(bodies, "x"), "x").filter(near).select("x", "y", "x_comp", "y_comp"))
        large = checkpointed(pairs.groupBy(F.col("x").alias("label")).agg(F.ceil(F.count("*") / STAR).alias("parts")).filter("parts > 1"))
        star_rows = pairs.withColumn("label", F.col("x")).join(small(large), "label", "left").withColumn("part", F.pmod(F.xxhash64("y"), F.coalesce("parts", F.lit(1).cast("long"))))
        held = star_rows.select("label", "part", F.col("x").alias("cls"), F.col("x_comp").alias("comp")).distinct()
        found = linked(held, star_rows.select("label", "part", F.col("y").alias("cls"), F.col("y_comp").alias("comp"), F.array("x").alias("xs")))
        links = found if links is None else links.unionByName(found)
        comps = components(links)

    if not done:
        now = labelled(comps)
        sizes = now.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
        open_ = sizes.groupBy("bucket").agg(F.count("*").alias("several"), F.sum("size").alias("k"), F.max(F.struct("size", "comp")).alias("top")).filter("several > 1")
        open_ = checkpointed(open_.select("bucket", "k", (F.col("k") - F.col("top.size")).alias("outside"), F.col("top.comp").alias("most")))
        found = linked(*dealt(stored(across(now.drop("k").join(open_, "bucket"), reps.select("cls", "n", "sig", "keys"), percent, bands), "minhash-pairs")))
        comps = components(links.unionByName(found))

    names = reps.select("cls", "same", "low")
    if comps is not None:
        named = comps.withColumnRenamed("id", "cls").join(names.select("cls", "low"), "cls")
        named = named.join(named.groupBy("comp").agg(F.min("low").alias("least")), "comp").select("cls", "least")
        names = names.join(named, "cls", "left").select("same", F.coalesce("least", "low").alias("low"))
    names = checkpointed(names.select("same", "low"))
    full = base.filter("same is not null").select("id", "n", "same").join(names, "same", "left").select("id", "n", F.col("low").alias("comp"))
    out = full.unionByName(base.filter("same is null").select("id", "n", F.col("id").alias("comp")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.col("id").eqNullSafe(F.col("comp")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that `near_duplicates` keeps, with all their columns; null keys stay.

    Rows that share a key stay or go together: they stay if one of them is kept.
    """
    found = near_duplicates(docs, key, text, width, percent).filter("doc_id is not null")
    gone = checkpointed(found.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select(F.col("doc_id").cast(docs.schema[key].dataType).alias(key)))
    return docs.join(small(gone), key, "left_anti").select(*docs.columns)
