"""Byte-level BPE encoding and decoding with batched numpy merge rounds."""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices

#: Fixed value: how byte-level vocabularies of this kind split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words of more bytes keep the ranks of their pairs from one round to the next.
LONG = 200
#: Distinct pre-tokens whose ids a Python worker remembers.
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file.

    Printable characters of Latin-1 stand for themselves; the other bytes take code points from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class NumpyBPE:
    """A byte-level BPE vocabulary: ids for texts, and texts for ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.words = regex.compile(PATTERN)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = max([*vocab.values(), *special.values()]) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, 0)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        pieces = [b""] * self.size
        for t, i in vocab.items():
            pieces[i] = bytes(byte_of[c] for c in t)
        for t, i in special.items():
            pieces[i] = t.encode()
        self.piece_at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.known: dict[str, np.ndarray] = {}

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of non-empty words: in each round, every word merges its pair of lowest rank wherever it stands."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.merge_long(w)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        sym = self.byte_ids[np.frombuffer(b"".join([words[i] for i in short]), np.uint8)]
        word = np.repeat(np.array(short, np.int64), [len(words[i]) for i in short])
        none = len(self.merged)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            key = np.full(len(sym), -1, np.int64)
            key[:-1] = np.where(word[:-1] == word[1:], sym[:-1] * self.size + sym[1:], -1)
            at = np.searchsorted(self.keys, key)
            rank = np.where(self.keys[at] == key, self.ranks[at], none)
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            done = best == none
            if done.any():
                for s, n in zip(starts[done], sizes[done], strict=True):
                    out[word[s]] = sym[s : s + n].astype(np.int32)
                keep = np.repeat(~done, sizes)
                sym, word, rank = sym[keep], word[keep], rank[keep]
                best, sizes = best[~done], sizes[~done]
                if not len(sym):
                    break
            hit = rank == np.repeat(best, sizes)
            # Where a pair overlaps itself ("aaa"), every second hit of the run counts, from the left.
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
            hit &= (place - run) % 2 == 0
            sym[hit] = self.merged[rank[hit]]
            left = ~np.r_[False, hit[:-1]]
            sym, word = sym[left], word[left]
        return out

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; those that never merge have the number of merges."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.merged))

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word, by the same rounds; a round costs its merges, as ranks are renewed beside merged places only."""
        sym = self.byte_ids[np.frombuffer(word, np.uint8)].copy()
        n, none = len(sym), len(self.merged)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        live, rank = np.ones(n, bool), np.full(n, none, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[rank[at] < none]
            at = at[np.argsort(rank[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1):
                if len(part):
                    r = int(rank[part[0]])
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(heap, r)
                    waiting[r].append(part)

        rank[:-1] = self.ranked(sym[:-1], sym[1:])
        wait(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[live[at] & (rank[at] == r)]
            if not len(at):
                continue
            # Of pairs that overlap in a run, every second counts, from the left.
            follows = np.r_[False, after[at[:-1]] == at[1:]]
            place = np.arange(len(at))
            run = np.maximum.accumulate(np.where(follows, 0, place))
            at = at[(place - run) % 2 == 0]
            right = after[at]
            sym[at], live[right] = self.merged[r], False
            beyond = after[right]
            after[at] = beyond
            inner = beyond < n
            before[beyond[inner]] = at[inner]
            left = before[at]
            renew = np.unique(np.concatenate([at, left[left >= 0]]))
            last = after[renew] >= n
            rank[renew[last]] = none
            renew = renew[~last]
            rank[renew] = self.ranked(sym[renew], sym[after[renew]])
            wait(renew)
        return sym[live].astype(np.int32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as empty. Strings of special tokens in a text become their ids."""
        split = []
        for t in texts:
            parts: list = []
            for p in (self.cut.split(t) if self.cut and t else [t or ""]):
                if p in self.special:
                    parts.append(p)
                elif p:
                    parts += self.words.findall(p)
            split.append(parts)
        new = list(set().union(*split) - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(set().union(*split))
        for s, i in self.special.items():
            self.known[s] = np.array([i], np.int32)
        new = [w for w in new if w not in self.special]
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            self.known.update(zip(part, self.merge([w.encode() for w in part]), strict=True))
        get, empty = self.known.__getitem__, np.empty(0, np.int32)
        return [np.concatenate([*map(get, p)]) if p else empty for p in split]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of id sequences, special tokens included; bytes that are no UTF-8 become U+FFFD, ids beyond the vocabulary nothing."""
        out = []
        for x in ids:
            x = x[(x >= 0) & (x < self.size)].astype(np.int64)
            at, n = self.piece_at[x], self.piece_at[x + 1] - self.piece_at[x]
            ends = np.cumsum(n)
            take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + n, n)
            out.append(self.piece_bytes[take].tobytes().decode("utf-8", "replace"))
        return out


_models: dict[str, NumpyBPE] = {}


def model(path: str) -> NumpyBPE:
    """One model for each Python worker and file."""
    if path not in _models:
        _models[path] = NumpyBPE(path)
    return _models[path]


def bpe_encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; null counts as empty and gives no ids."""

    def run(batches):
        bpe = model(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts, 2_000_000):
                ids = bpe.encode(texts[lo:hi])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with `decoded`, the text of the column `ids`; a null list counts as empty."""
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "decoded")

    def run(batches):
        bpe = model(path)
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            flat = np.asarray(ids.flatten().fill_null(-1))
            n = np.asarray(ids.value_lengths().fill_null(0))
            texts = bpe.decode(np.split(flat, np.cumsum(n)[:-1])) if len(n) else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return encoded.drop("decoded").mapInArrow(run, f"{names}, decoded string")
