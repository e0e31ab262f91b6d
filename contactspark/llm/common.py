"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import remove, remove_at_exit

#: ASCII white space, which separates words, as a character list and as a regular expression.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_REGEX = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of the given folder, read by Spark so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, a new one, but only for local runs such as tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found


def cut(df: DataFrame) -> DataFrame:
    """df by a reliable checkpoint in the shared folder, with its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Paths written by stored() inside the open scratch() blocks.
_written: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what stored() has written inside, but for paths that are taken off the list."""
    _written.append([])
    try:
        yield _written[-1]
    finally:
        remove(spark, _written.pop())


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as parquet and read again: columnar, so smaller than a checkpoint. It goes with the scratch() block
    around, or at the program's end."""
    path = remove_at_exit(df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    for paths in _written[-1:]:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def giving_back(run: Callable) -> Callable:
    """The function of a mapInArrow whose memory goes back to the system when a task ends, as idle workers would hold it beside other stages."""

    @functools.wraps(run)
    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return lean


def numbered(df: DataFrame, key: str, row: str) -> DataFrame:
    """df with `row`, a number of each row's own that rises with the key, nulls last: the key itself if no row shares or lacks one.

    Otherwise rows are sorted by key, then by a hash of all they hold (but for maps and variants), in ranges; rows alike in all are numbered as they are
    met, so that a group of copies needs no single task.
    """
    shared = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").cast("long") > 1).select(key).unionAll(df.select(key).where(F.col(key).isNull()))
    if shared.isEmpty():
        return df.withColumn(row, F.col(key).cast("long"))
    hashed = [c for c in df.columns if not re.search("map<|variant", df.schema[c].dataType.simpleString())]
    order = [F.asc_nulls_last(key), F.xxhash64(*hashed), F.col(row)]
    placed = df.withColumn(row, F.monotonically_increasing_id())
    return stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()), "numbered")


def in_order(df: DataFrame, order: list[Column], before: dict[str, Column | None]) -> DataFrame:
    """df sorted by order in ranges and stored, with the sums, as longs, of some expressions (None: the number) over all rows that come before each.

    Ranges also go by rows, so that very many rows of one place in the order need no single task. Sums within a range
    are windows of that range; ranges are summed up on their own, and there are as many of them as partitions.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    sort = [*order, F.col("_tie")]
    placed = stored(tied.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_place", F.monotonically_increasing_id()).drop("_tie"), "in-order")
    placed = placed.withColumn("_range", F.shiftrightunsigned("_place", 33))
    ranges = placed.groupBy("_range").agg(*(F.sum(F.lit(1) if x is None else x).cast("long").alias(f"_{n}") for n, x in before.items()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in before))
    inside = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("_place").bitwiseAND((1 << 33) - 1)  # its number within the range
    sums = {n: place if x is None else F.coalesce(F.sum(x).over(inside).cast("long"), F.lit(0)) for n, x in before.items()}
    found = placed.select("*", *(x.alias(n) for n, x in sums.items())).join(F.broadcast(ranges), "_range")
    return found.select(*df.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in before))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, whatever the optimizer does with the projection around it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Code points of a block of text; a substring is found within its block, not from the text's start.
BLOCK = 1024


def blocks(text: Column) -> Column:
    """A text cut into blocks of BLOCK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """The code points of a text from start to end (exclusive), given its blocks (see let). What it costs follows the length, not the place."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    skip = F.pmod(start, F.lit(BLOCK)).cast("int")
    head = F.substring(F.coalesce(F.get(parts, first), F.lit("")), skip + 1, F.least(F.lit(BLOCK), end - start).cast("int"))
    whole = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.substring(F.coalesce(F.get(parts, last), F.lit("")), F.lit(1), F.pmod(end, F.lit(BLOCK)).cast("int"))
    return F.when(last == first, head).otherwise(F.concat(head, whole, tail))


def words(text: Column) -> Column:
    """The maximal runs of anything but ASCII white space, as an array; null and blank text give an empty one."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS_REGEX))


def distinct_sample(df: DataFrame, group: str, keys: list[str], rows: int) -> DataFrame:
    """`rows` rows of each group that differ in `keys`, those of the smallest hashes, or all where there are no more; of rows alike in keys the least by
    their other columns. A null group gives no rows.

    Copies are one row, so a group of nothing but copies is not lost. Rows whose hash lies above twice the share of the group that is wanted, by a sketch of its
    distinct ones, go before anything is shuffled: about 2 * rows of a group meet.
    """
    h = F.xxhash64(*keys)
    sizes = {r[0]: r[1] for r in df.where(F.col(group).isNotNull()).groupBy(group).agg(F.approx_count_distinct(h, 0.05)).collect()}
    if not sizes:
        return df.limit(0)
    share = F.create_map(*(F.lit(x) for g, n in sizes.items() for x in (g, min(1.0, (2 * rows + 100) / max(1, n)))))
    part = F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)
    rest = [c for c in df.columns if c != group]
    some = df.where(part < F.try_element_at(share, F.col(group))).groupBy(group, part.alias("_part"), h.alias("_h")).agg(F.min(F.struct(*rest)).alias("_row"))
    first = Window.partitionBy(group).orderBy("_part", "_h")
    return some.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= rows).select(group, *(F.col(f"_row.`{c}`") for c in rest)).select(df.columns)
