"""Finding input files on any Hadoop file system, and opening them in Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class InputFile:
    path: str
    size: int


def matching(spark: SparkSession, patterns: str | list[str]) -> list[InputFile]:
    """Files that match ``*``, ``?``, ``[0-2]``, ``{a,b}`` and ``~`` patterns, by pattern, then name.

    A pattern that matches nothing is a FileNotFoundError; directories stand for the files in them.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found: list[InputFile] = []
    for pattern in [patterns] if isinstance(patterns, str) else patterns:
        where = jvm.org.apache.hadoop.fs.Path(os.path.expanduser(pattern))
        files = where.getFileSystem(conf)
        hits = files.globStatus(where)
        if not hits:
            raise FileNotFoundError(f"no file matches {pattern}")
        own = []
        for hit in hits:
            inside = files.listStatus(hit.getPath()) if hit.isDirectory() else [hit]
            own += [InputFile(x.getPath().toString(), x.getLen()) for x in inside if not x.isDirectory() and x.getPath().getName()[0] not in "._"]
        found += sorted(own, key=lambda f: f.path)
    return found


def plain(path: str) -> str:
    """A path without the ``file:`` scheme, as keys and file names show it."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def opened(path: str):
    """The pyarrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), plain(path)
    return fs.FileSystem.from_uri(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset a local session gets a temporary one;
    a cluster's executors wouldn't see that, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftflow-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path that all executors see."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
