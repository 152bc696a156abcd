"""Files that tasks write to, and read from, the shared folder (any scheme that pyarrow.fs knows)."""

from __future__ import annotations

import uuid

import numpy as np


def resolve(uri: str):
    """(file system, path) of a URI or of a plain absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def make(uri: str) -> None:
    """Create a folder of the shared folder (so that readers find it when no task writes a file)."""
    system, path = resolve(uri)
    system.create_dir(path, recursive=True)


def publish(uri: str, data) -> None:
    """Write bytes (or a list of buffers) under a private name, then rename: readers never see half a file, and a
    repeated task attempt replaces the file with equal bytes."""
    system, path = resolve(uri)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(part) as out:
        for x in data if isinstance(data, list) else [data]:
            out.write(x)
    system.move(part, path)


def read_range(uri: str, offset: int, length: int) -> bytes:
    system, path = resolve(uri)
    with system.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


def mapped(uri: str, dtype, offset: int, count: int) -> np.ndarray:
    """count values at a byte offset: memory-mapped where the shared folder is mounted, else read once."""
    from pyarrow import fs

    system, path = resolve(uri)
    if count == 0:
        return np.zeros(0, dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r", offset=offset, shape=(count,))
    return np.frombuffer(read_range(uri, offset, count * np.dtype(dtype).itemsize), dtype)
