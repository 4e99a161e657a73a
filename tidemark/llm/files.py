"""Whole files in the shared folder, written and read by tasks through pyarrow's file systems."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI (file, hdfs, s3, gs, or a plain path) and its path there."""
    if re.match(r"file:/[^/]", uri):
        uri = "file://" + uri[len("file:") :]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def make_folder(uri: str) -> None:
    system, path = open_folder(uri)
    system.create_dir(path, recursive=True)


def write_whole(folder: str, name: str, data: bytes) -> None:
    """One file that appears complete or not at all; a repeated task writes the same name again."""
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft, compression=None) as out:
        out.write(data)
    system.move(draft, f"{path}/{name}")
