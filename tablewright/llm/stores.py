"""Plain files in the shared folder, read and written inside tasks."""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyarrow import fs


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


class Draft:
    """A file that appears under its name once it is complete.

    An attempt writes under a name of its own; what it commits is the same as what any
    other attempt at the task commits, so it does not matter whose file stays.
    """

    def __init__(self, folder: str, name: str) -> None:
        self._store, base = open_store(folder)
        self._store.create_dir(base, recursive=True)
        self._final = f"{base}/{name}"
        self._own = f"{base}/_temporary-{uuid.uuid4().hex}"
        self._out = self._store.open_output_stream(self._own, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self._out.close()
        self._store.move(self._own, self._final)

    def discard(self) -> None:
        self._out.close()
        self._store.delete_file(self._own)


def read_range(folder: str, name: str, offset: int, length: int) -> bytes:
    store, base = open_store(folder)
    with store.open_input_file(f"{base}/{name}") as file:
        return file.read_at(length, offset)


def open_file(folder: str, name: str) -> BinaryIO:
    store, base = open_store(folder)
    return store.open_input_stream(f"{base}/{name}", compression=None)
