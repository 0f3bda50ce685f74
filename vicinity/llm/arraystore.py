"""Sorted arrays in the cluster's shared folder: written by tasks, memory-mapped by workers.

Files are written under a name of their own and renamed, so a task that runs
again or twice leaves the same file.  Where the shared folder is not a mounted
one (its URI has another scheme than file), a worker copies a file once into an
unnamed local file and maps that; nothing is left behind.
"""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs


def _local(base: str) -> str | None:
    parts = urlsplit(base)
    return parts.path if parts.scheme in ("", "file") else None


def write_array(base: str, name: str, values: np.ndarray) -> None:
    temp = f"{name}.{uuid.uuid4().hex}"
    if (folder := _local(base)) is not None:
        os.makedirs(folder, exist_ok=True)
        values.tofile(f"{folder}/{temp}")
        os.replace(f"{folder}/{temp}", f"{folder}/{name}")
        return
    fs, folder = pafs.FileSystem.from_uri(base)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/{temp}") as out:
        out.write(memoryview(values).cast("B"))
    fs.move(f"{folder}/{temp}", f"{folder}/{name}")


@functools.lru_cache(maxsize=512)
def map_array(base: str, name: str, dtype: str) -> np.ndarray:
    """The array as a read-only memory map (maps and copies go when they leave the cache)."""
    if (folder := _local(base)) is not None:
        path = f"{folder}/{name}"
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    fs, folder = pafs.FileSystem.from_uri(base)
    with fs.open_input_stream(f"{folder}/{name}") as src, tempfile.TemporaryFile() as copy:
        shutil.copyfileobj(src, copy)
        copy.flush()
        return np.memmap(copy, dtype, "r") if copy.tell() else np.zeros(0, dtype)


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Integers for the shuffle: differences if ascending, bytes regrouped by place, compressed."""
    if ascending and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, dtype, ascending: bool = False) -> np.ndarray:
    dtype = np.dtype(dtype)
    n = int.from_bytes(data[:8], "little")
    flat = pa.decompress(data[8:], decompressed_size=n * dtype.itemsize, codec="zstd", asbytes=True)
    values = np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).ravel()
    return np.cumsum(values, dtype=dtype) if ascending else values


def sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(keys) else counts
