"""Paths through Hadoop's file API, so any file system the cluster mounts works."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _handle(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _handle(spark, path)
    return fs.exists(jpath)


def resolve(spark: SparkSession, path: str) -> str:
    fs, jpath = _handle(spark, path)
    return fs.resolvePath(jpath).toString()


def size_of(spark: SparkSession, path: str) -> int:
    fs, jpath = _handle(spark, path)
    return fs.getContentSummary(jpath).getLength()


def matching(spark: SparkSession, pattern: str) -> list[str]:
    fs, jpath = _handle(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(jpath) or []))


def read_small(spark: SparkSession, path: str) -> str:
    fs, jpath = _handle(spark, path)
    stream = fs.open(jpath)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Create ``path`` whole or not at all; of several writers one succeeds, the others get FileExistsError.

    The text goes to a draft of its own, and a rename that never overwrites claims the
    name. That is atomic where the file system's rename is (HDFS, local disks).
    """
    jvm = spark._jvm
    fs, jpath = _handle(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jpath.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(jpath), options)
    except Exception as problem:
        fs.delete(draft, False)
        if fs.exists(jpath):
            raise FileExistsError(path) from problem
        raise


def remove(spark: SparkSession, path: str) -> None:
    fs, jpath = _handle(spark, path)
    fs.delete(jpath, True)


def usable_sources(spark: SparkSession, target: str, sources: list[str]
                   ) -> tuple[list[tuple[int, str]], list[tuple[int, str, str]]]:
    """Split source paths into usable (ordinal, path) and skipped (ordinal, path, reason).

    Ordinals are places in the argument list, from 1; 0 is the target's.
    """
    if not exists(spark, target):
        raise FileNotFoundError(f"target does not exist: {target}")
    home = resolve(spark, target)
    good, bad = [], []
    for ordinal, path in enumerate(sources, start=1):
        if not exists(spark, path):
            bad.append((ordinal, path, "missing"))
        elif resolve(spark, path) == home:
            bad.append((ordinal, path, "same as target"))
        else:
            good.append((ordinal, path))
    return good, bad
