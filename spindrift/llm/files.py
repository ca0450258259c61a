"""Binary files that tasks write to, and read from, the folder that all machines share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs) or of a plain path."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def make_folder(uri: str) -> None:
    system, path = place(uri)
    system.create_dir(path, recursive=True)


@contextmanager
def committed(uri: str) -> Iterator:
    """A stream whose file appears at ``uri`` only when the block ends well.

    A task that is lost leaves nothing there; one that runs again replaces the file by an equal one.
    """
    system, path = place(uri)
    at = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(at) as stream:
        yield stream
    system.move(at, path)


@contextmanager
def opened(uri: str) -> Iterator:
    system, path = place(uri)
    with system.open_input_file(path) as file:
        yield file
