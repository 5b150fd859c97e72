"""Files of an own format in the folder that driver and executors share.

``file:`` addresses are opened directly; other schemes go through pyarrow's
file systems (hdfs, s3, gs, abfs). A file appears under its name only when it
is whole, so a task that runs twice leaves the same file.
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

from pyarrow import fs


def file_system(address: str) -> tuple[fs.FileSystem, str]:
    parsed = urlparse(address)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    return fs.FileSystem.from_uri(address)


@contextmanager
def create(address: str):
    """Open ``address`` for writing; it takes its name when the block ends well."""
    system, path = file_system(address)
    system.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        yield out
    system.move(draft, path)


def open_for_ranges(address: str):
    """Open ``address`` for reads at any place."""
    system, path = file_system(address)
    return system.open_input_file(path)
