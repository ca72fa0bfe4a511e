"""Files in the shared folder, from tasks and the driver alike."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def make_folder(uri: str) -> None:
    files, path = _at(uri)
    files.create_dir(path, recursive=True)


@contextmanager
def written(uri: str):
    """A stream whose file appears under its name only when it is whole; a repeated task replaces it."""
    files, path = _at(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        yield out
    files.move(part, path)


def opened(uri: str):
    files, path = _at(uri)
    return files.open_input_file(path)
