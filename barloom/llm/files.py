"""Files in the shared folder, from executors, by whatever file system its address names."""

from __future__ import annotations

import uuid

import pyarrow.fs


def at(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and the path of an address; s3a is s3 and an address without a scheme is a local path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def opened(uri: str):
    """A file for reading at any place."""
    fs, path = at(uri)
    return fs.open_input_file(path)


class replaced:  # noqa: N801
    """A file that is written aside; done() puts it in place whole, dropped() takes it away. Two attempts at one task
    write two files of which the last one to end stays, and both hold the same."""

    def __init__(self, uri: str):
        self.fs, self.path = at(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.aside = f"{self.path}.{uuid.uuid4().hex}.part"
        self.stream = self.fs.open_output_stream(self.aside)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def done(self) -> None:
        self.stream.close()
        self.fs.move(self.aside, self.path)

    def dropped(self) -> None:
        self.stream.close()
        self.fs.delete_file(self.aside)
