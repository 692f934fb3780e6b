"""Paths of files for tasks: local ones, or of any store that Arrow opens."""

from __future__ import annotations

import os
from urllib.parse import urlsplit

import pyarrow.fs


def absolute(path: str) -> str:
    """The path as a task in another folder can use it."""
    return path if "://" in path else os.path.abspath(path)


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and the path in it."""
    if "://" not in path:
        return pyarrow.fs.LocalFileSystem(), os.path.abspath(path)
    system, own = pyarrow.fs.FileSystem.from_uri(path)
    return system, own.rstrip("/")


def shown(root: str, path: str) -> str:
    """A path that was found in the store of ``root``, as a whole one."""
    if "://" not in root:
        return path
    parts = urlsplit(root)
    return f"{parts.scheme}://{parts.netloc if path.startswith('/') else ''}{path}"
