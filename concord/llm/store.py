"""Files of our own formats in the shared folder, written and read inside tasks.

A task writes under a name of its own and reports it in the rows it returns. Spark commits those
rows once per task, so files of lost or repeated attempts are never referred to.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    local = re.match(r"(?:file:)?/+(.*)", uri)
    if local:
        return fs.LocalFileSystem(), "/" + local[1]
    return fs.FileSystem.from_uri(uri)


def new_name(folder: str, suffix: str) -> str:
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"


def writer(uri: str):
    files, path = _open(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    return files.open_output_stream(path)


def reader(uri: str):
    files, path = _open(uri)
    return files.open_input_stream(path)


def mapped(uri: str) -> np.ndarray:
    """The bytes of a file: memory-mapped where the shared folder is mounted, else read once."""
    files, path = _open(uri)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r").view(np.ndarray) if files.get_file_info(path).size else np.zeros(0, np.uint8)
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(f.size()), np.uint8)
