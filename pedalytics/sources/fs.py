"""Writing of workbooks from executors, through pyarrow's filesystem layer.

Paths are full URIs (the driver asks Spark's filesystem for the scheme), so
an executor never takes a shared folder for one on its own disk.
"""

from __future__ import annotations

from urllib.parse import unquote

import pyarrow.fs as pafs


def resolve(path: str):
    if ":" not in path.split("/", 1)[0]:
        raise ValueError(f"a path without a scheme names no shared folder: {path}")
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    fs, p = pafs.FileSystem.from_uri(path)
    return fs, unquote(p)


def write_bytes(path: str, data: bytes) -> None:
    fs, p = resolve(path)
    parent = p.rsplit("/", 1)[0]
    if parent:
        fs.create_dir(parent, recursive=True)
    with fs.open_output_stream(p) as f:
        f.write(data)
