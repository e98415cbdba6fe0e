"""Shared pieces of the corpus operators: word pattern, digests, bounded Arrow slices, table reading."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed value: a word is a run of characters other than space, tab and line ends
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one step inside a task holds at a time (a longer text stands alone).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the named text column holds about `limit` bytes per slice."""
    for batch in batches:
        lengths = batch.column(column)
        start, held = 0, 0
        for i, value in enumerate(pa.compute.binary_length(lengths).to_pylist()):
            if held and held + (value or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += value or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def schema_with(df: DataFrame, drop: tuple[str, ...], added: str) -> str:
    """DDL of a frame's columns without `drop`, followed by `added`."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in drop]
    return ", ".join([*kept, added])


#: Parts that `salted_join` deals the rows of one key to.
SALTS = 16


def salted_join(rows: DataFrame, unique: DataFrame, keys: list[str], spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join rows to a table with one row per key, dealing the rows of a key to `salts` tasks by column `spread`."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
