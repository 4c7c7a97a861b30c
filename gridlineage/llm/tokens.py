"""Token ids of whole texts by the tokenizers library, one distinct chunk at a time."""

from __future__ import annotations

import ctypes
import functools
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

#: Letters before ASCII punctuation other than an apostrophe.
PUNCTUATED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
#: Bytes of distinct chunks with their ids that a Python worker remembers, and what an entry takes beside them.
REMEMBERED, ENTRY = 48_000_000, 150
#: A mark that ends a word of ASCII letters before white space; it's a chunk of its own, so that the word is one with and without it.
ENDING = re.compile(rb"[!,.:;?](?<=[a-z].)(?![^ \t-\r])")


def lettered(word: str) -> bool:
    """True if a word is letters alone when it is lower-cased and composed; a mark that some letters leave would go with what follows."""
    return unicodedata.normalize("NFC", word.lower()).isalpha() if not word.isascii() else word.isalpha()


class Known(dict):
    """Ids of chunks as bytes. A chunk that isn't known gets an empty array, to be filled, and is listed as new.

    Chunks are kept in two runs: where the later one is full, the earlier one is dropped and takes its place, so
    that what comes again and again is never lost.
    """

    def __init__(self):
        super().__init__()
        self.earlier: dict[bytes, bytes] = {}
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> bytes | bytearray:
        found = self.earlier.get(chunk)
        if found is None:
            found = bytearray()
            self.new.append(chunk)
        self[chunk] = found
        return found

    def turn(self) -> None:
        self.earlier = dict(self)
        self.clear()


class ChunkEncoder:
    """Encodes texts with a lower-casing tokenizer that splits at white space and drops it.

    For such a tokenizer the ids of a text are those of its chunks between ASCII white space in turn, so
    each distinct chunk is encoded once by the library and remembered. A-Z are lower-cased first, unless
    the text may hold a special token, which is case-sensitive.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # The same without its normaliser, which leaves lower-case ASCII letters as they are; the model is shared.
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = self.library.pre_tokenizer
        self.kind = "H" if self.library.get_vocab_size() <= 65_536 else "I"
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.known = Known()
        self.held = 0

    def clear(self) -> None:
        self.known = Known()
        self.held = 0

    def learn(self, new: list[bytes]) -> None:
        """Fills the arrays of new chunks and remembers their ids.

        Letters followed by ASCII punctuation other than an apostrophe are two chunks in one. Words of
        letters alone, which end in one end-of-word id each, go to the library together.
        """
        plain, pairs, other = [], [], []
        for raw in new:
            if raw.isalpha():
                plain.append(raw)
                continue
            w = raw.decode("utf-8", "surrogatepass")
            if lettered(w):
                plain.append(raw)
            elif (m := PUNCTUATED.fullmatch(w)) and lettered(m[1]):
                head, tail = m[1].encode(), m[2].encode()
                pairs.append((raw, head, tail))
                if self.ids_of(head) is None:
                    plain.append(head)
                if self.ids_of(tail) is None:
                    other.append(tail)
            else:
                other.append(raw)
        if pairs:
            plain, other = list(dict.fromkeys(plain)), list(dict.fromkeys(other))
        known, fill = self.known, self.fill
        simple = [w for w in plain if w.isalpha()]
        plain = [w for w in plain if not w.isalpha()]
        groups = [words[i : i + 200] for words in (simple, plain) for i in range(0, len(words), 200)]
        for lo in range(0, len(groups), 50):
            some = groups[lo : lo + 50]
            texts = [b" ".join(g).decode("utf-8", "surrogatepass") for g in some]
            tool = self.plain if all(t.isascii() and t.islower() for t in texts) else self.library
            for part, e in zip(some, tool.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.kind)
                ends = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
                if len(ends) != len(part):
                    other += part
                    continue
                data, at = ids.tobytes(), 0
                for w, end in zip(part, ends, strict=True):
                    array_of = known[w]
                    array_of += (own := data[at:end])
                    known[w], at = own, end
                self.held += len(data) + sum(map(len, part))
        for i in range(0, len(other), 5_000):
            part = other[i : i + 5_000]
            for w, e in zip(part, self.library.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in part], add_special_tokens=False), strict=True):
                fill(w, array(self.kind, e.ids).tobytes())
        for raw, head, tail in pairs:
            fill(raw, known[head] + known[tail])
        known.new = []

    def fill(self, chunk: bytes, ids: bytes) -> None:
        array_of = self.known[chunk]
        array_of += ids
        self.known[chunk] = ids
        self.held += len(chunk) + len(ids)

    def ids_of(self, chunk: bytes) -> bytes | None:
        """The ids of a chunk if they are known already."""
        return self.known.get(chunk) or self.known.earlier.get(chunk) or None

    def encode(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        """The ids of each text with `end` appended; null counts as empty."""
        known, last = self.known, array(self.kind, [end]).tobytes()
        if ENTRY * len(known) + self.held > REMEMBERED // 2:
            known.turn()
            self.held = 0
        get, found = known.__getitem__, []
        for t in texts:
            data = t.encode("utf-8", "surrogatepass") if t else b""
            words = ENDING.sub(rb" \g<0>", data if b"<|" in data else data.lower()).split()
            found.append([*map(get, words), last])
        new, known.new = known.new, []
        try:
            self.learn(new)
        except BaseException:
            # No array that is empty still may pass for a chunk without ids.
            self.clear()
            raise
        return [np.frombuffer(b"".join(w), self.kind) for w in found]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Drops what this Python worker remembers; tasks of other operators call it, as workers are used again."""
    for e in _encoders.values():
        e.clear()


def release() -> None:
    """Gives memory that is free in this Python worker back to the system: Arrow's pool and, where the C library can, the heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run):
    """`run`, a task's function of its batches, before which the worker forgets and after which it releases what it doesn't need.

    Workers are used again, by other operators too, so what a task leaves stands beside what later ones need.
    """

    @functools.wraps(run)
    def whole(batches):
        forget()
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def slices(texts: list[str | None], most: int = 2_000_000):
    """Runs of texts of about `most` characters, so that what a task holds is bounded by that and the longest text."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 50
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
