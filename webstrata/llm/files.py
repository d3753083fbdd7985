"""Files of the shared folder, opened by tasks through the path Spark gives them."""

from __future__ import annotations

import re

import pyarrow.fs


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), re.sub(r"^file:", "", path)


def open_input(path: str) -> pyarrow.NativeFile:
    system, name = file_system(path)
    return system.open_input_file(name)


def open_output(path: str) -> pyarrow.NativeFile:
    system, name = file_system(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(name)
