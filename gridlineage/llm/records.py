"""Token ids in files of length-delimited records, with an offset index beside each."""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, shared_dir, stored
from .tokens import encoder, slices

#: A record: 8 bytes of length, 4 of its masked checksum, the payload, 4 of the payload's masked checksum.
HEAD, TAIL = 12, 4
#: Fixed value: what is added to a checksum after its rotation by 15 bits.
MASK = 0xA282EAD8
#: A payload: doc_id (8 bytes), 1 if that is set, width of an id, then the ids.
FRONT = 10


def masked(data: bytes) -> int:
    """A CRC-32 that is safe to store beside data that holds CRCs itself."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = len(payload).to_bytes(8, "little")
    return b"".join((n, masked(n).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def unframe(data: memoryview, at: int, path: str = "") -> tuple[bytes, int]:
    """The payload of the record at a position, and where the next one starts; ValueError where a checksum fails."""
    head = bytes(data[at : at + 8])
    n = int.from_bytes(head, "little")
    if len(head) < 8 or masked(head) != int.from_bytes(data[at + 8 : at + HEAD], "little"):
        raise ValueError(f"{path}: the length at {at} is damaged")
    payload = bytes(data[at + HEAD : at + HEAD + n])
    if len(payload) < n or masked(payload) != int.from_bytes(data[at + HEAD + n : at + HEAD + n + TAIL], "little"):
        raise ValueError(f"{path}: the record at {at} is damaged")
    return payload, at + HEAD + n + TAIL


def place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def write_records(docs: DataFrame, folder: str, path: str, end: int = 2, files: int | None = None) -> DataFrame:
    """Encodes `docs` and writes them in ascending doc_id order; returns one row for each file.

    Each range of doc_id becomes part-N.records and part-N.index; the index has a little-endian offset and
    length of 8 bytes each for every record, so a reader can take records in any order. A task writes under
    a name of its own and renames at the end, so a task that runs again leaves the same files. Null texts
    are empty documents; a null doc_id comes first and stays null; equal doc_ids are ordered by their text.
    """
    fs_uri = folder

    def run(batches):
        tool, part = encoder(path), TaskContext.get().partitionId()
        fs, base = place(fs_uri)
        fs.create_dir(base, recursive=True)
        own, name = uuid.uuid4().hex, f"part-{part:06d}"
        at = rows = ids_in_file = 0
        first = None
        with fs.open_output_stream(f"{base}/.{own}.records") as out, fs.open_output_stream(f"{base}/.{own}.index") as index:
            for b in batches:
                keys, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
                for lo, hi in slices(texts):
                    for key, x in zip(keys[lo:hi], tool.encode(texts[lo:hi], end), strict=True):
                        record = frame((key or 0).to_bytes(8, "little", signed=True) + bytes([key is not None, x.dtype.itemsize]) + x.tobytes())
                        out.write(record)
                        index.write(at.to_bytes(8, "little") + len(record).to_bytes(8, "little"))
                        at, rows, ids_in_file = at + len(record), rows + 1, ids_in_file + len(x)
                        first = key if rows == 1 else first
        for kind in ("records", "index"):
            if rows:
                fs.move(f"{base}/.{own}.{kind}", f"{base}/{name}.{kind}")
            else:
                fs.delete_file(f"{base}/.{own}.{kind}")
        if rows:
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "rows": rows, "ids": ids_in_file, "bytes": at}], pa.schema([("part", pa.int64()), ("name", pa.string()), ("rows", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    n = files or 4 * partitions(docs.sparkSession)
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ranged.mapInArrow(run, "part long, name string, rows long, ids long, bytes long"), "records-files")


def read_records(files: DataFrame, folder: str) -> DataFrame:
    """Every record of the files: doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit)."""
    fs_uri = folder

    def run(batches):
        fs, base = place(fs_uri)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist(), strict=True):
                with fs.open_input_stream(f"{base}/{name}.index") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
                with fs.open_input_file(f"{base}/{name}.records") as f:
                    lo = 0
                    while lo < len(index):
                        hi = max(lo + 1, int(np.searchsorted(index[:, 0], index[lo, 0] + 4_000_000)))
                        f.seek(int(index[lo, 0]))
                        data, rows = memoryview(f.read(int(index[hi - 1].sum() - index[lo, 0]))), []
                        for at in index[lo:hi, 0] - index[lo, 0]:
                            payload, _ = unframe(data, int(at), name)
                            ids = np.frombuffer(payload, f"<u{payload[9]}", offset=FRONT)
                            rows.append((int.from_bytes(payload[:8], "little", signed=True) if payload[8] else None, start, len(ids), ids.astype("<u4").tobytes()))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        lo = hi

    starts = files.select("part", "name", "bytes", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("start"))
    starts = stored(starts, "records-starts")
    return starts.repartition(max(1, min(files.count(), 4 * partitions(files.sparkSession)))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def new_folder(spark) -> str:
    return f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
