"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Folder below the shared one that stored() writes to just now.
_WITHIN: ContextVar[str] = ContextVar("within", default="")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset in a local session (tests), a folder of our own; on a cluster no local folder
    would do."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """All tables that are stored within go at the end."""
    name = f"/scratch-{uuid.uuid4().hex}"
    before = _WITHIN.set(_WITHIN.get() + name)
    try:
        yield
    finally:
        delete(spark, shared_folder(spark) + _WITHIN.get())
        _WITHIN.reset(before)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors. Most of what is
    written are ids of hexadecimal digits, which zstd halves."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}{_WITHIN.get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote, once all that reads them has been written."""
    for df in tables:
        delete(df.sparkSession, df.stored_at)


def beside(spark: SparkSession, *runs: Callable) -> list:
    """What runs return, none of which waits for another: for several small jobs, where planning and starting them takes most
    of the time. Tables go to the folder that stored() writes to where this is called."""
    with ThreadPoolExecutor(len(runs)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(copy_context().run), run) for run in runs]
        return [x.result() for x in waiting]
