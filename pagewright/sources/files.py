"""Files by path or URI, on the driver and in tasks: plain paths and file: URIs of this machine, other schemes by Arrow's
file systems (hdfs, viewfs, s3 and its variants, gs, abfs).

A plain path is one folder on one machine only. Where a cluster's machines share a folder under a path, name it by a file: URI.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHUNK = 4 << 20


def scheme(path: str) -> str | None:
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", path)
    return found[1].lower() if found else None


def rooted(path: str) -> str:
    """An absolute path, or the URI as it is."""
    return path if scheme(path) else os.path.abspath(path)


def joined(folder: str, *names: str) -> str:
    return "/".join([folder.rstrip("/") or folder, *names])


def _system(path: str):
    from pyarrow import fs

    kind = scheme(path)
    if kind in (None, "file"):
        return fs.LocalFileSystem(), os.path.abspath(re.sub(r"^file:/*(?=/)", "", path, flags=re.I))
    return fs.FileSystem.from_uri(re.sub(r"^s3[an](?=:)", "s3", path, flags=re.I))


def exists(path: str) -> bool:
    from pyarrow import fs

    system, plain = _system(path)
    return system.get_file_info(plain).type != fs.FileType.NotFound


def listed(folder: str, suffix: str) -> list[str]:
    """Files of a folder whose names end so, by name; none where there is no such folder."""
    from pyarrow import fs

    system, plain = _system(folder)
    found = system.get_file_info(fs.FileSelector(plain, allow_not_found=True))
    return [joined(folder, x.base_name) for x in sorted(found, key=lambda x: x.base_name) if x.type == fs.FileType.File and x.base_name.endswith(suffix)]


def folders(folder: str) -> list[str]:
    """Names of a folder's folders; none where there is no such folder."""
    from pyarrow import fs

    system, plain = _system(folder)
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(plain, allow_not_found=True)) if x.type == fs.FileType.Directory)


def read(path: str) -> bytes:
    system, plain = _system(path)
    with system.open_input_stream(plain) as file:
        return file.read()


@contextmanager
def written(path: str) -> Iterator:
    """A stream to a file that gets its name when all is written, so that nobody sees a part of it."""
    system, plain = _system(path)
    system.create_dir(os.path.dirname(plain), recursive=True)
    held = f"{plain}.{uuid.uuid4().hex}"
    with system.open_output_stream(held) as out:
        yield out
    system.move(held, plain)


def write(path: str, content: bytes) -> None:
    with written(path) as out:
        out.write(content)


@contextmanager
def local(path: str) -> Iterator[str]:
    """A path under which this task's programs can read a file: its own, or that of a copy that goes with the block. Copied
    piece by piece, never held whole."""
    system, plain = _system(path)
    if scheme(path) in (None, "file"):
        yield plain
        return
    with tempfile.TemporaryDirectory() as own:
        copy = os.path.join(own, os.path.basename(plain))
        with system.open_input_stream(plain) as file, open(copy, "wb") as out:
            while piece := file.read(CHUNK):
                out.write(piece)
        yield copy


def shared(spark: SparkSession, path: str) -> str:
    """A rooted path that all machines of a session see; an error for a plain path where they are several."""
    master = spark.conf.get("spark.master", "")
    if scheme(path) is None and master != "local" and not master.startswith("local["):
        raise RuntimeError(f"{path} is a folder of one machine, and {master} has several: name one that all see by its URI")
    return rooted(path)
