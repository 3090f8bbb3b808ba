"""File-system steps through Hadoop's API, so every path that Spark can open works."""

from __future__ import annotations

import datetime as dt

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` (a glob too) names at least one file or folder."""
    p, fs = _fs(spark, path)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders inside ``path``; empty if it does not exist."""
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def make_folder(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.mkdirs(p)


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files inside ``path``; empty if it does not exist."""
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile()) if fs.exists(p) else []


def folders_changed(spark: SparkSession, path: str) -> list[tuple[str, dt.datetime]]:
    """Names of the folders inside ``path`` and when each was last changed."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [(s.getPath().getName(), dt.datetime.fromtimestamp(s.getModificationTime() / 1000, dt.timezone.utc)) for s in fs.listStatus(p) if s.isDirectory()]


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether exactly ``path`` exists (no glob)."""
    p, fs = _fs(spark, path)
    return fs.exists(p)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files under a folder."""
    p, fs = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is no such file."""
    p, fs = _fs(spark, path)
    try:
        stream = fs.open(p)
    except Py4JJavaError as e:
        if "FileNotFoundException" in e.java_exception.getClass().getName():
            return None
        raise
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def move_if_absent(spark: SparkSession, source: str, target: str) -> bool:
    """Make the file ``source`` appear as ``target`` in one step; False if ``target`` is there.

    On a local disk by a hard link (a rename there would overwrite), else by a rename that
    the store refuses when the target exists.
    """
    jvm = spark.sparkContext._jvm
    p, fs = _fs(spark, source)
    to, _ = _fs(spark, target)
    fs.mkdirs(to.getParent())
    try:
        if fs.getUri().getScheme() == "file":
            link, existing = (jvm.java.io.File(x.toUri().getPath()).toPath() for x in (to, p))
            jvm.java.nio.file.Files.createLink(link, existing)
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(p, to, options)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
