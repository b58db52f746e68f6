"""Binary files of the operators, in any store that pyarrow's file systems reach (local, HDFS, S3, GCS)."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def atomic_write(uri: str):
    """A stream to a private name that takes its real name when all is written.

    A task that is repeated or runs twice leaves one whole file.
    """
    fs, path = locate(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    stream = fs.open_output_stream(own)
    try:
        yield stream
        stream.close()
        fs.move(own, path)
    except BaseException:
        stream.close()
        fs.delete_file(own)
        raise


def open_random(uri: str):
    fs, path = locate(uri)
    return fs.open_input_file(path)
