"""Tables of a run in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of up to so many narrow rows, counted first, is broadcast; a larger one is joined by shuffle.
SMALL_ROWS = 500_000

#: Folders of tables written by this process that are still there, by path.
_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names.

    Where that is unset, the session's own checkpoint folder serves, and in local mode a temporary one.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spanlens-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/spanlens-{uuid.uuid4().hex}"


def materialise(df: DataFrame, at: str | None = None) -> DataFrame:
    """df as a table written to the shared folder: it is computed once, and survives lost executors.

    discard() deletes it; what is left is deleted when the process ends. With at, the table is the caller's.
    """
    spark, own = df.sparkSession, at is None
    at = at or shared_dir(spark)
    if own:
        _WRITTEN[at] = spark
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_to = at
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of materialise(), once nothing that is still to be computed reads them."""
    for t in tables:
        if spark := _WRITTEN.pop(getattr(t, "written_to", ""), None):
            _delete(spark, t.written_to)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _delete_all() -> None:
    while _WRITTEN:
        at, spark = _WRITTEN.popitem()
        with contextlib.suppress(Exception):  # the session may be over
            _delete(spark, at)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, a written table of few and short columns, to be broadcast if its rows are few enough (SMALL_ROWS)."""
    if df.count() > (SMALL_ROWS if rows is None else rows):
        return df
    out = F.broadcast(df)
    out.written_to = getattr(df, "written_to", "")
    return out
