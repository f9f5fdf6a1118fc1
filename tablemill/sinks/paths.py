"""Paths that executors and the driver see alike, and part files that appear only when their job commits."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyarrow import fs


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path on it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def local_path(path: str) -> str:
    """A path below a mounted folder; decoders that need a real file work on these only."""
    system, inner = filesystem(path)
    if not isinstance(system, fs.LocalFileSystem):
        raise ValueError(f"PATH_NOT_MOUNTED: {path} must lie on a file system mounted on all executors.")
    return inner


def list_files(path: str, endings: tuple[str, ...]) -> list[str]:
    """The file itself, or the data files below a folder in name order."""
    system, inner = filesystem(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [inner]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(endings)
                  and "/_temporary/" not in f.path and not f.base_name.startswith(("_", ".")))


class PartFiles:
    """Attempts write below ``_temporary``; the commit moves the winners into place and the rest goes."""

    def __init__(self, folder: str, ending: str):
        self.folder, self.ending, self.job = folder, ending, uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{self.folder.rstrip('/')}/_temporary/{self.job}"

    @contextmanager
    def attempt(self, partition: int):
        """A fresh path for one task attempt: ``(file system, path)``."""
        system, inner = filesystem(self.staging)
        system.create_dir(inner, recursive=True)
        yield system, f"{inner}/part-{partition:05d}-{uuid.uuid4().hex}{self.ending}"

    def commit(self, paths: list[str]) -> None:
        system, inner = filesystem(self.folder)
        for path in paths:
            system.move(path, f"{inner}/{path.rsplit('/', 1)[-1]}")
        self.clear()
        with system.open_output_stream(f"{inner}/_SUCCESS"):
            pass

    def clear(self) -> None:
        system, inner = filesystem(self.staging)
        if system.get_file_info(inner).type == fs.FileType.Directory:
            system.delete_dir(inner)
