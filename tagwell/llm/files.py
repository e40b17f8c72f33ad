"""Files in the shared folder, by any URI that pyarrow's file systems know."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from typing import BinaryIO

from pyarrow import fs as pafs


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1))


@contextmanager
def written_once(uri: str) -> Iterator[BinaryIO]:
    """A file to write under a name of its own, renamed at the end, so that readers see whole files only and a repeated task does no harm."""
    fs, path = resolve(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(own, buffer_size=1 << 20) as out:
            yield out
        fs.move(own, path)
    except BaseException:
        with suppress(OSError):
            fs.delete_file(own)
        raise


def write_once(uri: str, data: bytes) -> None:
    with written_once(uri) as out:
        out.write(data)


def local_path(uri: str) -> str | None:
    """Path that can be memory-mapped, or None for remote stores."""
    fs, path = resolve(uri)
    return path if isinstance(fs, pafs.LocalFileSystem) else None


def read(uri: str) -> bytes:
    fs, path = resolve(uri)
    with fs.open_input_file(path) as f:
        return f.read()
