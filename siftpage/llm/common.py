"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body`, inside one expression.

    A separate projection would do too, but a filter pushed below it copies the value's expression
    into every place that uses it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal digits, modulo `parts`; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary one; a cluster must name it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="siftpage-"))
    return context.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """The local name of a path on a file system that every machine mounts."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: memory mapping needs spark.checkpoint.dir on a mounted file system")
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: the rows as a Parquet table in the shared folder, read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(name: str, taken: Sequence[str]) -> str:
    """A column name that none of `taken` is, whatever their case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def quoted(names: Sequence[str]) -> list[Column]:
    """Columns by their literal names, dots and blanks included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def slices(texts: pa.Array, size: int = 1_000_000) -> Iterator[list[str]]:
    """The texts of a batch (null: empty) in lists of about `size` bytes, one text at least."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // size)) + 1
    for rows in np.split(np.arange(len(lengths)), cuts) if len(lengths) else []:
        yield [t or "" for t in texts.slice(int(rows[0]), len(rows)).to_pylist()]


def small_batches(spark: SparkSession) -> None:
    """Batches to Python workers of some megabytes: whole texts are long, and a batch is held in the
    executor and in the worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def give_back() -> None:
    """Hand freed memory back to the system: a Python worker lives on after its task and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
