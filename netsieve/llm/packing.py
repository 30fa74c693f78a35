"""Compact bytes for integer and float arrays that travel in shuffle rows and scratch files."""

from __future__ import annotations

import io
import re
import struct

import numpy as np
import pyarrow as pa


def _squeeze(kind: bytes, a: np.ndarray) -> bytes:
    """Bytes of equal significance together (the high ones are mostly zero), then zstd."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
    return struct.pack("<cBQ", kind, a.itemsize, len(a)) + (pa.compress(planes, codec="zstd", asbytes=True) if len(a) else b"")


def pack_ints(a: np.ndarray) -> bytes:
    top = int(a.max()) if len(a) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return _squeeze(b"u", a.astype(f"<u{width}"))


def pack_floats(a: np.ndarray) -> bytes:
    return _squeeze(b"f", a.astype("<f8"))


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending 64-bit keys, as differences."""
    return _squeeze(b"s", np.diff(a, prepend=a.dtype.type(0)).astype("<u8"))


def unpack(data: bytes) -> np.ndarray:
    """Integers as uint64 (``pack_sorted``) or int64, floats as float64."""
    kind, width, n = struct.unpack_from("<cBQ", data)
    raw = pa.decompress(memoryview(data)[10:], n * width, codec="zstd", asbytes=True) if n else b""
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(
        f"<f{width}" if kind == b"f" else f"<u{width}").ravel()
    if kind == b"s":
        return np.cumsum(a, dtype=np.uint64)
    return a if kind == b"f" else a.astype(np.int64)


def file_system(uri: str):
    """pyarrow file system and path of a Spark path (shared folder: local, HDFS, object store)."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def save(uri: str, arrays: dict[str, bytes | np.ndarray]) -> None:
    out = io.BytesIO()
    np.savez(out, **{k: np.frombuffer(v, np.uint8) if isinstance(v, bytes) else v for k, v in arrays.items()})
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(out.getvalue())


def load(uri: str) -> dict[str, np.ndarray]:
    fs, path = file_system(uri)
    with fs.open_input_stream(path) as f:
        return dict(np.load(io.BytesIO(f.read())))
