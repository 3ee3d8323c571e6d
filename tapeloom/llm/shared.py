"""Files that tasks write to and read from the cluster's shared folder.

A task gives each file a name of its own and reports it in a row. Only files in
the written table of such rows are read, so what a lost or repeated task leaves
behind is never seen.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def new_file(folder: str, stem: str, suffix: str) -> str:
    """Path of a file that no other attempt writes; the folder is made if needed."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"


@contextmanager
def writer(path: str):
    system, at = fs.FileSystem.from_uri(path)
    with system.open_output_stream(at, compression=None) as stream:
        yield stream


@contextmanager
def reader(path: str):
    """A file open for reading at any place."""
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as stream:
        yield stream
