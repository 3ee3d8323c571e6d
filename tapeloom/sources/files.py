"""Files that tasks open by the paths Spark lists."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import NativeFile, fs

# Hadoop's names of object store schemes and the ones the file systems here know.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss"}


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Hadoop writes it; a local path needs no scheme."""
    scheme, mark, rest = path.partition(":")
    if not mark or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


@contextmanager
def reader(path: str) -> Iterator[NativeFile]:
    """A file open for reading at any place."""
    system, at = located(path)
    with system.open_input_file(at) as stream:
        yield stream
