"""Small files on the store that driver and executors share, through Spark's own file systems."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class VersionTaken(RuntimeError):
    """Another writer has made this version meanwhile: read the newest one and try again."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if it does not exist."""
    path = _path(spark, folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []


def read_json(spark: SparkSession, path: str):
    stream = _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration()).open(_path(spark, path))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish_json(spark: SparkSession, path: str, value) -> None:
    """Write a file that appears whole or not at all, and never in place of another one.

    The content goes to a name of its own first and is renamed; renaming onto a file that exists fails.
    """
    jvm, target = spark._jvm, _path(spark, path)
    part = _path(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.part")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(part, False)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(part, target, rename)
    except Py4JJavaError as error:
        system.delete(part, False)
        if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
            raise VersionTaken(path) from None
        raise


def drop(spark: SparkSession, folder: str) -> None:
    path = _path(spark, folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
