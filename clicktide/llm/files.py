"""Binary files in the shared folder, written and read inside tasks.

A task writes under a name no other attempt can have and returns the name in
its rows.  Those rows are written as a table; Spark commits only one attempt of
each task, so a name found in the table is a complete file, whatever executors
were lost.  Files of failed attempts are never read.  Bytes are stored as they
are given, whatever the name ends in.
"""

import posixpath
import re
import uuid

from pyarrow import fs


def _resolve(path: str):
    # Hadoop writes file:/x, URIs have file:///x
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def new_name(folder: str, label: str) -> str:
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def create(path: str):
    """An output stream; missing folders are made."""
    system, place = _resolve(path)
    system.create_dir(posixpath.dirname(place), recursive=True)
    return system.open_output_stream(place, compression=None)


def read_bytes(path: str) -> bytes:
    system, place = _resolve(path)
    with system.open_input_stream(place, compression=None) as stream:
        return stream.read()


def open_stream(path: str):
    system, place = _resolve(path)
    return system.open_input_stream(place, compression=None)
