"""Files by any path that Spark reads: through Hadoop's file systems, never the machine's own."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own_roots: dict[str, str] = {}


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob pattern matches, in order of name."""
    fs, at = _at(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(at) or [])


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    fs, at = _at(spark, path)
    out = fs.create(at, True)
    try:
        out.write(content, 0, len(content))
    finally:
        out.close()


def write_joined(spark: SparkSession, path: str, parts: list[bytes | tuple[str, str, int]]) -> None:
    """Bytes one after another in one file; ``(name, folder, size)`` stands for so many bytes that are
    the pieces in Spark's text files of that folder, each a length in eight bytes and that many.
    They pass the driver as a stream and are never held there."""
    fs, at = _at(spark, path)
    copy = spark._jvm.org.apache.commons.io.IOUtils.copyLarge
    out = fs.create(at, True)
    try:
        for part in parts:
            if isinstance(part, bytes):
                out.write(part, 0, len(part))
                continue
            name, folder, size = part
            for piece in matching(spark, f"{folder}/part-*"):
                own, place = _at(spark, piece)
                left, source = own.getFileStatus(place).getLen(), own.open(place)
                try:
                    while left > 0:
                        n = source.readLong()
                        size -= copy(source, out, 0, n)
                        left -= 8 + n + len(source.readNBytes(1))  # the end of the line
                finally:
                    source.close()
            if size:
                raise ValueError(f"{name} has {'fewer' if size > 0 else 'more'} values than its dimensions")
    finally:
        out.close()


def remove(spark: SparkSession, folder: str) -> None:
    fs, at = _at(spark, folder)
    fs.delete(at, True)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path for intermediate files in the folder that driver and executors share,
    ``spark.checkpoint.dir``; where that is unset and everything runs in one process, in a folder
    that is removed at the end. On a cluster without a shared folder it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_roots:
            folder = tempfile.mkdtemp(prefix="halocline-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own_roots[app] = f"file://{folder}"
        root = _own_roots[app]
    return f"{root.rstrip('/')}/halocline/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{tag}"
