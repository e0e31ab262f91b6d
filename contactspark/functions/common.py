"""Helpers for small tables and integer arithmetic."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rows and bytes of a side that is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and BROADCAST_BYTES; else as it is, so that Spark shuffles it.

    The rows that show this (one over the bound at most) are kept, so a small side is worked out only once.
    """
    found = df.limit(rows + 1).toArrow()
    if found.num_rows > rows or found.nbytes > BROADCAST_BYTES:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out by a hash of some columns to all partitions of a shuffle: for a short table that is about to grow, which would else stay in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*by))


def floor_div(a: Column, b: int | Column) -> Column:
    """a // b rounded down, for b > 0, also where a is negative."""
    b = b if isinstance(b, Column) else F.lit(b)
    return ((a - F.pmod(a, b)) / b).cast("long")


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of whichever store Spark can reach."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Scratch folders that are there.
_made: list[str] = []


def remove_at_exit(spark: SparkSession, path: str) -> str:
    """path, which goes when the program ends, as nothing can read it any more then."""
    if not _made:
        atexit.register(_remove_made, spark)
    _made.append(path)
    return path


def _remove_made(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # Spark may have been stopped; its folder goes with it, or is the user's to clear
        remove(spark, _made)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir), removed at the program's end. Where that is unset, a temporary one for local
    runs, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return remove_at_exit(spark, f"{base or tempfile.mkdtemp(prefix='maps-')}/{name}-{uuid.uuid4().hex}")
