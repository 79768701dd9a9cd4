"""Small text files through Hadoop's file systems, so that they may lie wherever tables may."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str) -> tuple:
    """A path and its file system; the local one without checksum files, so that a rename replaces a file in one step."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return (fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a file in one step: written beside it, then renamed over it, so that readers find the old text or the new one."""
    fs, p = _path(spark, path)
    _, temporary = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    fs.mkdirs(p.getParent())
    stream = fs.create(temporary, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.getUri().getScheme() == "file":
        done = fs.rename(temporary, p)
    else:
        hadoop = spark._jvm.org.apache.hadoop.fs
        option = getattr(hadoop, "Options$Rename")
        overwrite = spark._sc._gateway.new_array(option, 1)
        overwrite[0] = option.valueOf("OVERWRITE")
        hadoop.FileContext.getFileContext(temporary.toUri(), spark._jsc.hadoopConfiguration()).rename(temporary, p, overwrite)
        done = True
    if not done:
        raise OSError(f"cannot write {path}")


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes a file, with its checksum if it has one, or a folder with all it holds."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.delete(p, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of a folder's files, without markers and checksums."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return 0
    files, total = fs.listFiles(p, True), 0
    while files.hasNext():
        f = files.next()
        total += 0 if f.getPath().getName()[0] in "._" else f.getLen()
    return total


def state(spark: SparkSession, path: str) -> str:
    """Length and latest change of a file or folder's files: another text as soon as one is written."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return ""
    status = fs.getFileStatus(p)
    found = list(fs.listStatus(p)) if status.isDirectory() else [status]
    return f"{path}:{len(found)}:{sum(f.getLen() for f in found)}:{max((f.getModificationTime() for f in found), default=0)}"


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds."""
    fs, p = _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


@contextmanager
def locked(spark: SparkSession, path: str, seconds: float = 60.0) -> Iterator[None]:
    """Holds a lock file, which only one writer can create; TimeoutError if another keeps it. A lock left by a dead writer must be deleted by hand."""
    fs, p = _path(spark, path)
    fs.mkdirs(p.getParent())
    until = time.monotonic() + seconds
    while not fs.createNewFile(p):
        if time.monotonic() > until:
            raise TimeoutError(f"another writer holds {path}")
        time.sleep(0.1)
    try:
        yield
    finally:
        fs.delete(p, False)
