"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import pickle
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample
from .tokens import slices, tidied

WORD = re.compile(r"\w+")
#: Weights are kept for hashed features; prefixes let inflected words share evidence.
WEIGHTS, PREFIXES = 1 << 18, (4, 5, 6)
#: Labelled documents of either class that the model is fitted on, at most.
PER_CLASS = 2000
#: Tokens on both sides of a marked token that go into a training sequence.
AROUND = 12
#: Distinct words whose scores a Python worker remembers.
REMEMBERED = 150_000


def evidence(word: str) -> list[str]:
    """What a token is judged by: the word, and its beginnings."""
    w = word.lower()
    return [w, *(f"{w[:k]}*" for k in PREFIXES if len(w) >= k)]


def hashes(word: str) -> list[int]:
    return [zlib.crc32(e.encode("utf-8", "surrogatepass")) or 1 for e in evidence(word)]


def ragged(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of falling length: how many have a step t, where step t starts in time order, and the time order of the joined rows."""
    n = np.array([len(r) for r in rows])
    live = np.bincount(n, minlength=n.max(initial=0) + 1)[::-1].cumsum()[::-1][1:]
    at = np.concatenate([[0], np.cumsum(live)])
    row = np.repeat(np.arange(len(rows)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return live, at, at[step] + row


@dataclass
class Chain:
    """Two states (0 clean, 1 toxic); trans[i, j] scores a step from i to j, start the first state 1."""

    weights: np.ndarray
    trans: np.ndarray
    start: float
    scale: np.ndarray | None = None

    def passes(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """Forward and backward log odds of state 1 for emissions of sequences of falling length, in time order."""
        live, at, order = ragged(rows)
        e = np.empty(len(order), np.float32)
        e[order] = np.concatenate(rows) if rows else np.empty(0, np.float32)
        np.clip(e, -30, 30, out=e)
        t = np.exp(self.trans).astype(np.float32)
        a, b = np.empty_like(e), np.zeros_like(e)
        for k in range(len(live)):
            here = slice(at[k], at[k + 1])
            if k:
                x = np.exp(np.clip(a[at[k - 1] : at[k - 1] + live[k]], -30, 30))
                a[here] = e[here] + np.log((t[0, 1] + t[1, 1] * x) / (t[0, 0] + t[1, 0] * x))
            else:
                a[here] = e[here] + self.start
        for k in range(len(live) - 1, 0, -1):
            x = np.exp(np.clip(e[at[k] : at[k + 1]] + b[at[k] : at[k + 1]], -30, 30))
            b[at[k - 1] : at[k - 1] + live[k]] = np.log((t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x))
        return e, a, b, (live, at, order)

    def marginals(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of state 1 at each token of each sequence, given the whole sequence."""
        full = [i for i in sorted(range(len(rows)), key=lambda i: -len(rows[i])) if len(rows[i])]
        out = [np.empty(0, np.float32)] * len(rows)
        if full:
            _, a, b, (_, _, order) = self.passes([rows[i] for i in full])
            p = (1 / (1 + np.exp(-np.clip(a + b, -60, 60))))[order]
            for i, part in zip(full, np.split(p, np.cumsum([len(rows[i]) for i in full])[:-1]), strict=True):
                out[i] = part
        return out

    def score(self, p: np.ndarray) -> float:
        """A document's probability to be toxic, from the marginals of its tokens."""
        return float(1 / (1 + np.exp(-(summary(p) @ self.scale))))


def summary(p: np.ndarray) -> np.ndarray:
    top, mass = (float(p.max()), float(p[p > 0.05].sum())) if len(p) else (0.0, 0.0)
    return np.array([1.0, top, np.log1p(mass)])


class Words:
    """The distinct words of a sample by number, with the hashes of their evidence; texts become arrays of numbers."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        self.texts = [np.array([number.setdefault(w.lower(), len(number)) for w in WORD.findall(t)], np.int32) for t in texts]
        self.evidence = np.zeros((len(number), 1 + len(PREFIXES)), np.uint32)
        for w, i in number.items():
            e = hashes(w)
            self.evidence[i, : len(e)] = e
        self.has = self.evidence > 0

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.where(self.has, weights[self.evidence % WEIGHTS], 0).sum(1, dtype=np.float32)


def mark(words: Words, labels: list[int]) -> np.ndarray:
    """The evidence (hashes) that goes with toxic documents: it labels tokens, as only documents have labels.

    Counted are the distinct neighbourhoods in which a word or beginning stands, so that copies of one
    document count once. It is marked where a likelihood-ratio test against chance, held to one false
    alarm in all that is tested, finds it in toxic documents, and clean ones have it a tenth as often.
    """
    found, total = [], []
    for y in (0, 1):
        own = [t for t, label in zip(words.texts, labels, strict=True) if label == y and len(t)]
        ids = np.concatenate([np.r_[t, -1] for t in own]) if own else np.empty(0, np.int64)
        before, after = np.r_[-1, ids[:-1]] if len(ids) else ids, np.r_[ids[1:], -1] if len(ids) else ids
        real = ids >= 0
        around = ((before[real].astype(np.uint64) * np.uint64(0x9E3779B1) + after[real].astype(np.uint64) * np.uint64(0x85EBCA77)) & np.uint64(0xFFFFFFFF))
        # The distinct (evidence, neighbourhood) pairs of each kind of evidence; a short word has fewer kinds.
        kinds = [np.unique((words.evidence[ids[real], k].astype(np.uint64) << np.uint64(32)) | around) >> np.uint64(32) for k in range(words.evidence.shape[1])]
        e, n = np.unique(np.concatenate(kinds), return_counts=True)
        found.append((e[e > 0], n[e > 0]))
        total.append(max(1, int(real.sum())))
    (clean, c_n), (toxic, t_n) = found
    if not len(toxic):
        return toxic
    at = np.minimum(np.searchsorted(clean, toxic), max(len(clean) - 1, 0))
    c = np.where(clean[at] == toxic, c_n[at], 0) if len(clean) else np.zeros(len(toxic))
    share, t = total[1] / sum(total), t_n.astype(float)
    g = 2 * (t * np.log(t / ((t + c) * share)) + np.where(c > 0, c * np.log(np.maximum(c, 1) / ((t + c) * (1 - share))), 0))
    return toxic[(t >= 3) & (c / total[0] <= 0.1 * t / total[1]) & (g > 2 * np.log(max(len(toxic), 2)) + 2)]


def fit(sample: list[tuple[str, int]], rounds: int = 80, decay: float = 1e-4, seed: int = 3) -> Chain:
    """A model from texts with labels: tokens are labelled by `mark`, then the chain's likelihood is maximised.

    Training sequences are the AROUND tokens on both sides of every marked token, which is toxic in toxic texts
    and clean in clean ones, and of three random tokens of texts without a toxic one. Calibration sees whole texts.
    """
    words, labels = Words([t for t, _ in sample]), [y for _, y in sample]
    hot = (np.isin(words.evidence, mark(words, labels)) & words.has).any(1)
    rng = np.random.default_rng(seed)
    rows, targets = [], []
    for ids, y in zip(words.texts, labels, strict=True):
        hits = np.flatnonzero(hot[ids]) if len(ids) else np.empty(0, np.int64)
        middle, upto = np.sort(np.concatenate([hits, rng.integers(len(ids), size=3)])) if len(ids) and not (y and len(hits)) else hits, 0
        for i in middle:
            lo, hi = max(upto, i - AROUND), min(len(ids), i + AROUND + 1)
            if hi > lo:
                upto = hi
                rows.append(ids[lo:hi])
                targets.append((hot[ids[lo:hi]] & bool(y)).astype(np.float32))
    chain = Chain(np.zeros(WEIGHTS, np.float32), np.array([[0.0, -2.0], [0.0, 0.0]]), -2.0)
    if rows:
        by = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        ascend(chain, [rows[i] for i in by], [targets[i] for i in by], words, rounds, decay)
    calibrate(chain, words, labels)
    return chain


def ascend(chain: Chain, rows: list[np.ndarray], targets: list[np.ndarray], words: Words, rounds: int, decay: float) -> None:
    """Adagrad on the log likelihood of labelled sequences of falling length."""
    used = np.unique(np.concatenate(rows))
    of_word, kind = np.nonzero(words.has[used])
    of_feature = words.evidence[used][of_word, kind] % WEIGHTS
    rows = [np.searchsorted(used, r) for r in rows]
    flat, y = np.concatenate(rows), np.concatenate(targets)
    cuts = np.cumsum([len(r) for r in rows])[:-1]
    power, power_t = np.full(WEIGHTS, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        scores = np.bincount(of_word, chain.weights[of_feature], len(used)).astype(np.float32)
        e, a, b, (live, at, order) = chain.passes(np.split(scores[flat], cuts))
        p = 1 / (1 + np.exp(-np.clip(a + b, -60, 60)))
        truth = np.empty_like(e)
        truth[order] = y
        gap = np.bincount(flat, (truth - p)[order], len(used))
        grad = np.bincount(of_feature, gap[of_word], WEIGHTS) - decay * len(rows) * chain.weights
        grad_t = np.zeros((2, 2))
        if len(live) > 1:
            before = np.concatenate([np.arange(at[k - 1], at[k - 1] + live[k]) for k in range(1, len(live))])
            after = np.arange(at[1], at[-1])
            joint = [[chain.trans[i, j] + i * a[before] + j * (e[after] + b[after]) for j in (0, 1)] for i in (0, 1)]
            norm = np.logaddexp(np.logaddexp(joint[0][0], joint[0][1]), np.logaddexp(joint[1][0], joint[1][1]))
            for i in (0, 1):
                for j in (0, 1):
                    grad_t[i, j] = float(((truth[before] == i) & (truth[after] == j)).sum() - np.exp(joint[i][j] - norm).sum())
        power += grad**2
        power_t += grad_t**2
        chain.weights += (0.5 * grad / np.sqrt(power)).astype(np.float32)
        chain.trans = np.clip(chain.trans + 0.2 * grad_t / np.sqrt(power_t), -8, 8)
    first = np.array([t[0] for t in targets])
    chain.start = float(np.log((first.sum() + 0.5) / (len(first) - first.sum() + 0.5)))


def calibrate(chain: Chain, words: Words, labels: list[int], rounds: int = 400) -> None:
    """Logistic regression of document labels on `summary` of their marginals; a low constant where labels tell nothing apart."""
    scores = words.scores(chain.weights)
    x = np.array([summary(p) for lo in range(0, len(labels), 200) for p in chain.marginals([scores[t] for t in words.texts[lo : lo + 200]])]).reshape(-1, 3)
    y, w = np.array(labels, float), np.zeros(3)
    if len(set(labels)) < 2:
        chain.scale = np.array([-2.0, 0.0, 0.0])
        return
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3) * max(1, len(y)) / 100
        w += 0.5 * np.linalg.solve(h, x.T @ (y - p) - 1e-4 * len(y) * w)
    chain.scale = w


class Emissions(dict):
    """Scores of words, each computed once."""

    def __init__(self, chain: Chain):
        super().__init__()
        self.weights = chain.weights.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = s = sum([self.weights[h % WEIGHTS] for h in hashes(word)])
        return s


SCHEMA = "doc_id long, score double, spans array<struct<start: int, end: int, p: float>>"


def score(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, spans) for every whole text; spans are code points of tokens with a marginal of 0.5 or more.

    Null texts count as empty; an empty text has the score of one without toxic tokens. Nothing but the
    text enters a score. An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(chain)

    @tidied
    def run(batches):
        chain = model.value
        known = Emissions(chain)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float32())]))
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts, 1_500_000):
                rows = [np.array([known[w] for w in WORD.findall(t)] if t else [], np.float32) for t in texts[lo:hi]]
                scores, spans = [], []
                for t, p in zip(texts[lo:hi], chain.marginals(rows), strict=True):
                    scores.append(chain.score(p))
                    hot = set(np.flatnonzero(p >= 0.5).tolist())
                    spans.append([{"start": m.start(), "end": m.end(), "p": float(p[i])} for i, m in enumerate(WORD.finditer(t)) if i in hot] if hot else [])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(scores, pa.float64()), pa.array(spans, span)], ["doc_id", "score", "spans"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def clean_rows(docs: DataFrame, chain: Chain, limit: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores below `limit`, with all their columns."""
    model, at = docs.sparkSession.sparkContext.broadcast(chain), docs.columns.index(text)

    @tidied
    def run(batches):
        chain = model.value
        known = Emissions(chain)
        for b in batches:
            texts = b.column(at).to_pylist()
            for lo, hi in slices(texts, 1_500_000):
                rows = [np.array([known[w] for w in WORD.findall(t)] if t else [], np.float32) for t in texts[lo:hi]]
                yield b.slice(lo, hi - lo).filter(pa.array([chain.score(p) < limit for p in chain.marginals(rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Chain:
    """A model from at most `per_class` labelled documents of either class (and SAMPLE_BYTES of them), none of them held out.

    The sample is fitted in one task and only the model comes to the driver. Without labels, or with those of
    one class alone, there is no toxic word, and all documents score alike.
    """

    @tidied
    def run(batches):
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([(t, y) for _, t, y in rows]))], pa.binary())], ["model"])

    found = labelled_sample(docs, labels, "toxic", per_class).coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit([])
