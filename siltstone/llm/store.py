"""Files in a folder that driver and executors share, by URI."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

import pyarrow.fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``uri`` and the path in it: plain paths and file:// are local."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(parts.path)
    return pafs.FileSystem.from_uri(uri)


def create(uri: str):
    """A new file for writing; its folder is made if need be."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path, compression=None, buffer_size=1 << 20)


def opened(uri: str):
    """The file for reads of byte ranges: read_at(length, offset)."""
    fs, path = filesystem(uri)
    return fs.open_input_file(path)
