"""Readers of exported maps, call lists and side tables. Paths may be folders or patterns of any store that Spark reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import bounded
from ..operators.maps import check_resolutions
from . import schemas


def read_contact_map(spark: SparkSession, path: str, resolution: int, sample: str | None = None, fmt: str = "parquet") -> dict[str, DataFrame]:
    """chromsizes, bins and pixels of one resolution from path/chromsizes, path/bins and path/pixels; filters reach the scan."""
    def read(name: str, schema: str) -> DataFrame:
        reader = spark.read.schema(schema)
        return reader.parquet(f"{path}/{name}") if fmt == "parquet" else reader.csv(f"{path}/{name}", header=True)

    pixels = read("pixels", schemas.PIXELS)
    pixels = pixels.where(F.col("sample") == sample) if sample else pixels
    at = F.col("resolution") == resolution
    return {"chromsizes": read("chromsizes", schemas.CHROMSIZES), "bins": read("bins", schemas.BINS).where(at), "pixels": pixels.where(at)}


def validated_map(spark: SparkSession, path: str, resolution: int, required: tuple[int, ...] = (50_000, 10_000, 5_000)) -> dict[str, DataFrame]:
    """read_contact_map after a check that all required resolutions are there."""
    check_resolutions(spark.read.schema(schemas.PIXELS).parquet(f"{path}/pixels"), list(required))
    return read_contact_map(spark, path, resolution)


def read_sv_calls(spark: SparkSession, path: str, sep: str = ",", schema: str = schemas.SV_CALLS) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=True)


def read_wide_calls(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated calls of one or many files, with the file's name as source."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    return spark.read.csv(path, schema=schemas.WIDE_CALLS, sep="\t", header=True).withColumn("source", name)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, ref, alt and alt_len of the records; comments and short lines are left out."""
    f = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(f.alias("f")).where(F.size("f") >= 5)
    return lines.select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).try_cast("long").alias("pos"), F.get("f", F.lit(3)).alias("ref"), F.get("f", F.lit(4)).alias("alt")).withColumn("alt_len", F.length("alt").cast("long"))


def read_expected(spark: SparkSession, path: str, trans: bool = False) -> DataFrame:
    return spark.read.csv(path, schema=schemas.EXPECTED_TRANS if trans else schemas.EXPECTED, sep="\t", header=True)


def read_fasta_lengths(spark: SparkSession, path: str, keep_ids: list[str] | None = None) -> DataFrame:
    """chrom and length of each record, in files of any size. A record's name is its first line up to a blank; what stands before a file's first record is left out.

    Files are read by lines, in splits: a record may go on over many. Each split gives the lengths that it has met, by the record's number in it, where
    0 is the one left open by the splits before it in the file; which one that is follows from a table of one row a split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, name, size = (None, None), 0, None, 0  # the record that is open in this split

        def closed() -> tuple:
            return (*at, number, name, size)

        for b in batches:
            rows = []
            head = pc.starts_with(b["value"], ">").to_numpy(zero_copy_only=False)
            long = pc.utf8_length(pc.replace_substring(b["value"], "\r", "")).to_numpy(zero_copy_only=False).astype("i8")
            place = b["split"].to_numpy(zero_copy_only=False)
            file = b["file"].dictionary_encode()
            code = file.indices.to_numpy(zero_copy_only=False)
            fresh = np.r_[True, (place[1:] != place[:-1]) | (code[1:] != code[:-1])]
            cuts = np.flatnonzero(head | fresh)
            sums = np.add.reduceat(np.where(head, 0, long), cuts) if len(cuts) else []
            for k, total in zip(cuts.tolist(), sums.tolist() if len(cuts) else [], strict=True):
                here = (file.dictionary[code[k]].as_py(), int(place[k]))
                if here != at:
                    if at[0] is not None:
                        rows.append(closed())
                    at, number, name, size = here, 0, None, 0
                if head[k]:
                    rows.append(closed())
                    number, name, size = number + 1, b["value"][k].as_py()[1:].split(" ")[0].rstrip(), 0
                size += total
            yield as_batch(rows)
        if at[0] is not None:
            yield as_batch([closed()])

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"file": pa.string(), "split": pa.int64(), "number": pa.int64(), "name": pa.string(), "length": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    met = lines.mapInArrow(lengths, "file string, split long, number long, name string, length long")
    opened = met.groupBy("file", "split").agg(F.max("number").alias("last"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carry = F.last(F.when(F.col("last") > 0, F.struct(F.col("split").alias("s"), F.col("last").alias("n"))), True).over(before)
    carried = bounded(opened.select("file", "split", carry.alias("_open")))
    known = met.join(carried, ["file", "split"]).withColumn("_of", F.when(F.col("number") > 0, F.struct(F.col("split").alias("s"), F.col("number").alias("n"))).otherwise(F.col("_open")))
    out = known.where("_of is not null").groupBy("file", "_of").agg(F.max("name").alias("chrom"), F.sum("length").alias("length")).select("chrom", "length")
    return out.where(F.col("chrom").isin(keep_ids)) if keep_ids else out
