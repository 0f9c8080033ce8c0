"""Sharding by sampled splitters, DataFrame operations only.

Records are ordered by a 64-bit key: the leading bits are a hash of the text, so that
equal texts lie together, the rest a hash of the id and the row's number, so that a group of
equal texts of any size can be cut, whatever its ids. A sample in which a record appears in proportion to its size gives
quantile boundaries; they cut the order into many ranges. Exact sums per range show the
overfull ones, which are subdivided. Range sums and a running sum inside each range give
every record its exact place in bytes, and the place gives the shard: shard sizes differ
by about one record. No task sorts more than one range.

Only the boundaries and one row per range (`RANGES_PER_PARTITION` for each shuffle
partition, plus subdivisions) come to the driver.

Defined results: a null text has size 8, checksum 0 and the hash of an empty text; ties of
the key are ordered by id and checksum; null and repeated ids are rows like any other; identical
rows share the places they tie for; other columns are not carried over; an empty table gives no rows; with fewer records than shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.llm.common import count_at_most, landed

RECORD_BYTES = 8
RANGES_PER_PARTITION = 4
SAMPLE_PER_RANGE = 24
# A range with more than this many times the mean range is subdivided.
OVERFULL = 1.5
ROUNDS = 4
TEXT_BITS = 40


def keyed(docs: DataFrame) -> DataFrame:
    """`doc_id, size, text_crc32, key` of each row; land it, the keys hold row numbers."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = (1 << (63 - TEXT_BITS)) - 1
    # The sign bit stays clear, so the key orders as a plain long.
    key = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - TEXT_BITS), 63 - TEXT_BITS)
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        key.bitwiseOR(
            F.xxhash64("doc_id", F.monotonically_increasing_id()).bitwiseAND(F.lit(low))
        ).alias("key"),
    )


def sampled_splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantile boundaries of a size-weighted sample of keys.

    A record of size s is drawn floor(s / step + u) times, u a hash of its key, which
    makes about ranges * SAMPLE_PER_RANGE draws, whatever the number of records.
    """
    step = max(1.0, total / (ranges * SAMPLE_PER_RANGE))
    u = (F.xxhash64("key", F.lit("draw")).bitwiseAND(F.lit((1 << 32) - 1))) / float(1 << 32)
    drawn = (
        rows.select("key", F.floor(F.col("size") / step + u).cast("int").alias("draws"))
        .where("draws > 0")
        .groupBy("key")
        .agg(F.sum("draws").alias("draws"))
        .collect()
    )
    every, seen, out = sum(r["draws"] for r in drawn) / ranges, 0, []
    for key, draws in sorted((r["key"], r["draws"]) for r in drawn):
        seen += draws
        if every and seen >= every * (len(out) + 1):
            out += [key] * int(seen // every - len(out))
    return sorted(set(out))


def in_ranges(rows: DataFrame, splitters: list[int]) -> DataFrame:
    """Add `range`: how many splitters the key reaches."""
    if not splitters:
        return rows.withColumn("range", F.lit(0))
    edges = F.array(*map(F.lit, splitters))
    return rows.withColumn("range", count_at_most(edges, F.col("key"), len(splitters)))


def range_sums(rows: DataFrame) -> dict[int, tuple[int, int, int, int]]:
    """Bytes, records, least and greatest key of each range."""
    sums = rows.groupBy("range").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("records"),
        F.min("key").alias("low"), F.max("key").alias("high"),
    )
    return {r["range"]: (r["bytes"], r["records"], r["low"], r["high"]) for r in sums.collect()}


def subdivided(splitters: list[int], sums: dict, most: float) -> list[int]:
    """More splitters, at equal steps of the key, inside the ranges of more than `most` bytes."""
    added = set(splitters)
    for size, _, low, high in sums.values():
        if size > most and high > low:
            parts = min(int(size / most) + 1, high - low + 1)
            added.update(low + (high - low + 1) * k // parts for k in range(1, parts))
    return sorted(added)


def shard_rows(docs: DataFrame, shards: int) -> DataFrame:
    """Place every row of `docs` (`doc_id, text`) into shards of nearly equal bytes.

    Returns `doc_id, size, text_crc32, shard, slot`; slots count from 0 in each shard.
    """
    spark = docs.sparkSession
    rows = landed(keyed(docs), "shard-keys")
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = max(shards, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    splitters = sampled_splitters(rows, total, ranges)
    most = OVERFULL * total / ranges
    for _ in range(ROUNDS):
        placed = in_ranges(rows, splitters)
        sums = range_sums(placed)
        finer = subdivided(splitters, sums, most)
        if finer == splitters:
            break
        splitters = finer
    else:
        placed = in_ranges(rows, splitters)
        sums = range_sums(placed)

    before_bytes, before_rows, at_byte, at_row = [], [], 0, 0
    for r in range(len(splitters) + 1):
        before_bytes.append(at_byte)
        before_rows.append(at_row)
        size, records, *_ = sums.get(r, (0, 0))
        at_byte, at_row = at_byte + size, at_row + records

    def start(values: list[int]):
        return F.get(F.array(*(F.lit(v).cast("long") for v in values)), F.col("range"))

    inside = Window.partitionBy("range").orderBy("key", "doc_id", "text_crc32", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The middle of a record decides, so each shard is within a record of its share.
    middle = start(before_bytes) + F.sum("size").over(inside) - F.col("size") / 2
    ordered = placed.select(
        "doc_id", "size", "text_crc32",
        F.least(F.floor(middle * shards / max(total, 1)), F.lit(shards - 1)).cast("int").alias("shard"),
        (start(before_rows) + F.count("*").over(inside) - 1).alias("_row"),
    )
    firsts = ordered.groupBy("shard").agg(F.min("_row").alias("_first"))
    # One row per shard.
    return ordered.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )
