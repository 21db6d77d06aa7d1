"""Files in the shared folder, written and read by tasks."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write(uri: str, data: bytes | memoryview) -> None:
    files, path = store(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(path) as out:
        out.write(data)


def mapped(uri: str) -> pa.NativeFile:
    """Memory-mapped where the folder is mounted, else read on demand."""
    files, path = store(uri)
    return pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
