"""Parts of files on any file system or web server, read where tasks run."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs

from tilewright.sources.http import HttpFile

#: Schemes that stand for the same store as another one.
SAME_STORE = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "wasb": "abfs", "wasbs": "abfss"}


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and its path of an address: local files, HDFS, S3, GCS and Azure, with the credentials that these
    find in their environment."""
    scheme, mark, rest = path.partition(":")
    if not mark or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SAME_STORE.get(scheme, scheme)}:{rest}")


def opened(path: str) -> pa.NativeFile | HttpFile:
    """The file, to be read at any place."""
    if path.startswith(("http://", "https://")):
        return HttpFile(path)
    system, own = located(path)
    return system.open_input_file(own)


def read_range(path: str, offset: int, length: int) -> bytes:
    """The bytes from offset on, as many as there are up to length; none past the end, an error below zero."""
    if offset < 0 or length < 0:
        raise ValueError(f"range {offset} and {length}")
    with opened(path) as f:
        size = f.size()
        return f.read_at(min(length, size - offset), offset) if offset < size else b""


def size_of(path: str) -> int:
    system, own = located(path)
    return system.get_file_info(own).size


def made(folder: str) -> None:
    system, own = located(folder)
    system.create_dir(own, recursive=True)


def created(path: str) -> pa.NativeFile:
    """A new file to write to, with the folders that it needs."""
    system, own = located(path)
    if "/" in own:
        system.create_dir(own.rpartition("/")[0], recursive=True)
    return system.open_output_stream(own)


def moved(old: str, new: str) -> None:
    system, own = located(old)
    system.move(own, located(new)[1])
