"""Audio features of 8-bit samples: polyphase resampling, log-mel filterbanks, energy segments."""

from __future__ import annotations

import io
import wave
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices

#: Payloads are padded with bytes 255 to a multiple of BLOCK samples.
BLOCK = 576
RATE, UP, DOWN, TAPS = 8000, 3, 4, 16
FRAME, HOP, BANDS = 128, 64, 16
#: Segments open above the mean frame energy plus OPEN, and close below plus CLOSE, in standard deviations.
OPEN, CLOSE = 0.5, 0.0


def payload(data: bytes) -> bytes:
    """The samples for some bytes: followed by bytes 255 up to a positive multiple of BLOCK."""
    return data + b"\xff" * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples, which holds them unchanged."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, rate, len(samples), "NONE", "not compressed"))
        w.writeframes(samples)
    return out.getvalue()


def from_wav(data: bytes) -> tuple[bytes, int]:
    """Samples and rate of a mono 8-bit WAV file."""
    with wave.open(io.BytesIO(data), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not a mono file of 8-bit samples")
        return w.readframes(w.getnframes()), w.getframerate()


@lru_cache
def phases(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc low pass, split into one filter of `taps` taps for each of `up` phases."""
    n = up * taps
    t = (np.arange(n) - (n - 1) / 2) / max(up, down)
    h = np.sinc(t) * np.hamming(n)
    return (h / h.sum() * up).reshape(taps, up).T[:, ::-1].astype(np.float32).copy()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """`x` at up / down of its rate; each output sample applies the filter of its phase alone."""
    x = np.ascontiguousarray(x, np.float32)
    bank = phases(up, down, taps)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    n = -(-len(x) * up // down)
    out = np.empty(n, np.float32)
    for first in range(up):
        at = np.arange(first, n, up) * down
        if len(at):
            phase, start = at[0] % up, at // up
            step = down if len(start) > 1 else 1
            out[first::up] = windows[start[0] :: step][: len(start)] @ bank[phase]
    return out


@lru_cache
def filterbank(rate: float, frame: int, bands: int) -> np.ndarray:
    """Triangular mel filters over the bins of a frame's spectrum."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.clip(np.minimum(up, down), 0, None).T.astype(np.float32).copy()


def log_mel(x: np.ndarray, rate: float, frame: int = FRAME, hop: int = HOP, bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames x bands) of overlapped Hann frames, and the log energy of each frame; silence fills the last frame."""
    x = np.concatenate([x, np.zeros(max(frame - len(x), 0) or (frame - len(x)) % hop, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    window, bank = np.hanning(frame).astype(np.float32), filterbank(rate, frame, bands)
    out, energy = np.empty((len(frames), bands), np.float32), np.empty(len(frames), np.float32)
    for i in range(0, len(frames), 4096):
        part = frames[i : i + 4096] * window
        spectrum = np.fft.rfft(part)
        out[i : i + 4096] = np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bank + 1e-6)
        energy[i : i + 4096] = np.log(np.einsum("ij,ij->i", part, part) + 1e-6)
    return out, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames (start, end) that rise above the upper threshold, as far as they stay above the lower."""
    mean, spread = float(energy.mean(dtype=np.float64)), float(energy.std(dtype=np.float64))
    low, high = energy > mean + CLOSE * spread, energy > mean + OPEN * spread
    edge = np.flatnonzero(np.diff(np.r_[False, low, False].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return []
    loud = np.add.reduceat(np.r_[high, False].astype(np.int64), np.ravel(np.column_stack([starts, ends])))[::2] > 0
    return [(int(a), int(b)) for a, b in zip(starts[loud], ends[loud], strict=True)]


#: Frames of a tensor; the last tensor of a text is filled up with its lowest value.
TENSOR = 64
SCHEMA = "doc_id long, n_bytes long, payload binary, media binary, frames long, tensors binary, means array<float>, deviations array<float>, spans array<struct<start: double, end: double>>"


def to_tensors(mel: np.ndarray, second: float) -> bytes:
    """Log-mel frames as an Arrow stream of fixed-shape tensors (TENSOR x bands), each with the time it spans and its frames."""
    n = -(-len(mel) // TENSOR)
    filled = np.full((n * TENSOR, mel.shape[1]), mel.min(), np.float32)
    filled[: len(mel)] = mel
    first = np.arange(n) * TENSOR
    frames = np.minimum(len(mel) - first, TENSOR)
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(filled.reshape(n, TENSOR, -1))
    batch = pa.RecordBatch.from_arrays([tensors, pa.array(first * second), pa.array((first + frames) * second), pa.array(frames)], ["tensor", "start", "end", "frames"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def from_tensors(data: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Log-mel frames and the time spans of the tensors of a stored stream."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    tensors = table["tensor"].chunk(0).to_numpy_ndarray()
    frames = table["frames"].to_pylist()
    return np.concatenate([t[:n] for t, n in zip(tensors, frames, strict=True)]), list(zip(table["start"].to_pylist(), table["end"].to_pylist(), strict=True))


def features(media: bytes) -> tuple[bytes, np.ndarray, float, list[tuple[float, float]]]:
    """Samples of a stored file, its log-mel frames, the seconds from one to the next, and loud spans in seconds."""
    samples, rate = from_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x), rate * UP / DOWN)
    second = HOP / (rate * UP / DOWN)
    return samples, mel, second, [(a * second, b * second) for a, b in segments(energy)]


def audio_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each whole text as audio and computes features from the stored bytes; columns of SCHEMA.

    The payload is the text in UTF-8 (null: empty), padded by `payload`; media is a WAV file of it. `tensors`
    holds all log-mel frames as fixed-shape Arrow tensors with their time spans (`from_tensors` reads them);
    means and deviations are those of each band over all frames; spans are the loud parts in seconds. Each
    text is computed by itself, so equal texts have equal values wherever they stand. Rows that share a key,
    or have none, are texts of their own; further columns are not read. An empty table gives an empty result.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")[:8]] + ["spans"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.float32()), pa.list_(pa.float32()), pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))]

    def run(batches):
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in slices(texts, 500_000):
                cols: list[list] = [[] for _ in kinds]
                for t in texts[lo:hi]:
                    data = (t or "").encode("utf-8", "surrogatepass")
                    media = to_wav(payload(data))
                    back, mel, second, loud = features(media)
                    row = (len(data), back, media, len(mel), to_tensors(mel, second), mel.mean(0), mel.std(0), [{"start": s, "end": e} for s, e in loud])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
