"""Files that tasks write and read in the shared folder, through whichever file system its URI names."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO


def open_fs(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def written(uri: str) -> Iterator[BinaryIO]:
    """A new file that appears under its name only when whole, so a task that is lost or repeated leaves no partial one."""
    store, path = open_fs(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}.part"
    try:
        with store.open_output_stream(part) as f:
            yield f
    except BaseException:
        store.delete_file(part)
        raise
    store.move(part, path)


def opened(uri: str):
    """An existing file, open for random reads."""
    store, path = open_fs(uri)
    return store.open_input_file(path)
