"""Files in a folder that driver and executors share, by any URI pyarrow can open (file, hdfs, s3, gs)."""

from __future__ import annotations

import contextlib
import uuid
from urllib.parse import unquote, urlparse

from pyarrow import fs


def system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


def put(uri: str, parts: list[bytes]) -> None:
    """Writes a file under a name of its own and moves it into place, so a task run twice leaves one whole file."""
    files, path = system(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    with contextlib.suppress(FileNotFoundError):
        if files.get_file_info(path).type != fs.FileType.NotFound and not isinstance(files, fs.LocalFileSystem):
            files.delete_file(path)
    files.move(own, path)


def get(uri: str, at: int = 0, size: int | None = None) -> bytes:
    """A range of a file's bytes; a negative place counts from its end."""
    files, path = system(uri)
    with files.open_input_file(path) as f:
        if at < 0:
            at += f.size()
        f.seek(at)
        return f.read(f.size() - at if size is None else size)
