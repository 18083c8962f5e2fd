"""Single raw files, on a local path or through Hadoop's file systems.  A path without a scheme, or of scheme ``file``, is local."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

BUFFER = 4 << 20


def local(path: str) -> str | None:
    """The path on this machine, None if it is elsewhere."""
    found = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*):", path)
    if not found:
        return path
    return re.sub(r"^file:/*", "/", path) if found[1].lower() == "file" else None


def _remote(path: str):
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


@contextmanager
def writing(path: str) -> Iterator:
    """A function that appends bytes; the file appears under its name only when all of it is written."""
    here = local(path)
    if here is not None:
        os.makedirs(os.path.dirname(here) or ".", exist_ok=True)
        with open(f"{here}.part", "wb") as f:
            yield f.write
        os.replace(f"{here}.part", here)
        return
    fs, part = _remote(f"{path}.part")
    stream, held = fs.create(part, True), bytearray()

    def write(data: bytes) -> None:
        held.extend(data)
        if len(held) >= BUFFER:
            stream.write(bytes(held))
            held.clear()

    try:
        yield write
        stream.write(bytes(held))
    finally:
        stream.close()
    target = _remote(path)[1]
    fs.delete(target, False)
    fs.rename(part, target)


def read_range(path: str, start: int, end: int) -> Iterator[bytes]:
    """The bytes from ``start`` up to ``end`` in pieces of at most ``BUFFER``; a file that ends before is an error."""
    here = local(path)
    if here is not None:
        stream = open(here, "rb")  # noqa: SIM115
        stream.seek(start)
        read = stream.read
    else:
        fs, jpath = _remote(path)
        stream = fs.open(jpath)
        stream.seek(start)
        read = stream.readNBytes
    try:
        while start < end:
            piece = bytes(read(min(BUFFER, end - start)))
            if not piece:
                raise EOFError(f"{path} ends at byte {start}, {end} expected")
            yield piece
            start += len(piece)
    finally:
        stream.close()


def read_bytes(path: str, n: int | None = None) -> bytes:
    """The file, or its first ``n`` bytes."""
    here = local(path)
    if here is not None:
        with open(here, "rb") as f:
            return f.read() if n is None else f.read(n)
    fs, jpath = _remote(path)
    stream = fs.open(jpath)
    try:
        return bytes(stream.readAllBytes() if n is None else stream.readNBytes(n))
    finally:
        stream.close()
