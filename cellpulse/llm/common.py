"""Helpers the document operators share: words, folds, intermediate tables, orders split over tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import cellpulse
from cellpulse.plans.bounded import scratch_path

# A word is a run of characters other than these; both forms describe the same set.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
# Documents of this remainder are never learned from.
FOLDS, HELD_OUT = 3, 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder as Parquet and read back.

    Cuts the lineage, survives lost executors, and later readers take only the
    columns they use.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    That is enough on one machine or with a shared installation; elsewhere the package is
    shipped with the job as usual.
    """
    root = str(Path(cellpulse.__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def map_arrow(df: DataFrame, work, schema) -> DataFrame:
    """`mapInArrow` with functions of this package."""
    workers_import(df.sparkSession)
    return df.mapInArrow(work, schema)


def fold(doc_id: Column) -> Column:
    """Remainder of the checksum of the id's text; null ids fall into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == HELD_OUT


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null and blank texts."""
    bare = trimmed(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once.

    A lambda that names an outer expression evaluates it for every element, so
    the expression is bound to a lambda variable of its own.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_at_most(sorted_values: Column, wanted: Column, size: int) -> Column:
    """How many of `size` ascending values are <= `wanted`, by binary search."""
    steps = [1 << k for k in reversed(range(max(1, size).bit_length()))]

    def step(at: Column, width: Column) -> Column:
        reached = F.get(sorted_values, at + width - 1) <= wanted
        return F.when((at + width <= size) & reached, at + width).otherwise(at)

    if size == 0:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def order_bins(spark: SparkSession) -> int:
    """Bits of an order's leading bins, so that there are a few bins for each shuffle partition."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(16, max(4, (4 * partitions - 1).bit_length()))


def hash_bin(hashed: Column, bits: int) -> Column:
    """Leading bits of a 64-bit hash; ascending bins keep the hash's unsigned order."""
    return F.shiftrightunsigned(hashed, 64 - bits).cast("int")


def running_before(
    df: DataFrame, keys: list[str], bin_column: str, order: list, sums: dict[str, str]
) -> DataFrame:
    """Add, per key, the sum of each value over all rows before this one.

    The order is (bin, order...). Each task sorts one (key, bin) only; sums of whole
    bins are aggregated first and carried in, so a key with a third of all rows is
    spread over all its bins. `sums` maps new columns to value columns; keys are not null.
    """
    totals = df.groupBy(*keys, bin_column).agg(*(F.sum(v).alias(o) for o, v in sums.items()))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(bin_column)
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, bin_column,
        *(F.coalesce(F.sum(o).over(before), F.lit(0)).alias(f"_carried_{o}") for o in sums),
    )
    inside = Window.partitionBy(*keys, bin_column).orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumns(
        {o: F.coalesce(F.sum(v).over(inside), F.lit(0)) for o, v in sums.items()}
    ).join(carried, [*keys, bin_column])
    return placed.withColumns(
        {o: (F.col(o) + F.col(f"_carried_{o}")).cast("long") for o in sums}
    ).drop(*(f"_carried_{o}" for o in sums))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_chars: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `max_chars` bytes of a text column, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        begin, held = 0, 0
        for at, size in enumerate(sizes.to_pylist()):
            if at > begin and held + (size or 0) > max_chars:
                yield batch.slice(begin, at - begin)
                begin, held = at, 0
            held += size or 0
        if begin < batch.num_rows:
            yield batch.slice(begin)
