"""Paths as Spark gives them, opened by tasks through :mod:`pyarrow.fs`."""

from __future__ import annotations

import re
from functools import cache


@cache
def _root(scheme: str, authority: str):
    from pyarrow import fs

    if scheme in ("", "file"):
        return fs.LocalFileSystem()
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{authority}/")[0]


def split(path: str) -> tuple[str, str, str]:
    """Scheme, authority and the rest; a path may hold any character, escaped or not."""
    scheme, authority, rest = re.fullmatch(r"(?:([a-zA-Z][\w+.-]*):)?(?://([^/]*))?(.*)", path, re.DOTALL).groups()
    return (scheme or "").lower(), authority or "", rest


def resolve(path: str):
    """The file system of a path, and the path inside it."""
    scheme, authority, rest = split(path)
    return _root(scheme, authority), f"{authority}{rest}" if scheme.startswith(("s3", "gs", "gcs")) else rest


def open_path(path: str):
    """A file for random access, by the path that Spark's listing gives."""
    at, inside = resolve(path)
    return at.open_input_file(inside)
