"""Importance resampling of documents towards a target, over hashed word n-grams.

Texts are handled as UTF-8 bytes: a table of 256 bytes lower-cases A-Z and blanks whatever is
not a digit, a letter or a byte of a longer character, and `bytes.split` yields the words. A
run of words is hashed by chaining: `zlib.crc32(next, crc of what came before)` extends an
n-gram without building it. Buckets of all texts and of the target's texts are reduced by
Counters to at most `buckets` numbers a task, merged by one aggregation, and become a gain per
bucket; a document's weight is the floored mean gain of its features. Gumbel noise from a hash
of the id turns the highest scores into a draw without replacement.

The draw needs a rank over all documents: (score, id, row) is cut by sampled ranges of the
full order, sorted there, and the ranges' counts, one row per task, carry ranks on. The row number
ends the order, so a score or an id with a third of all rows is spread like any other.

Defined results: a null or empty text, or one without a word, has no features, weight 0 and is never
drawn unless `least_words` is 0; a null id hashes as an empty one and comes after all others of
its score; rows with the same id are documents of their own, ties between them settled by row;
an empty table gives no rows; an empty target has no features; other columns are not carried over.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import landed, map_arrow, slices

BUCKETS, LONGEST = 10_000, 1
SEED, LEAST_WORDS, PERCENT = "2024", 20, 10
SLICE_BYTES = 4_000_000
# Digits and lower-case letters stay, upper-case ones become lower-case, bytes beyond ASCII stay.
TABLE = bytes(
    b if b > 127 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 65 <= b <= 90 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def buckets_of(words: list[bytes], longest: int, buckets: int) -> Counter:
    """How often each bucket occurs among the runs of 1 to `longest` words."""
    crc32 = zlib.crc32
    hashes = [crc32(w) for w in words]
    found = Counter(hashes)
    for n in range(1, longest):
        hashes = [crc32(w, crc32(b" ", h)) for h, w in zip(hashes, words[n:], strict=False)]
        found.update(hashes)
    out: Counter = Counter()
    for h, times in found.items():
        out[h % buckets] += times
    return out


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> dict[int, int]:
    """Features of all rows of `texts` (`text`) per bucket; at most `buckets` entries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in slices(batches, "text", SLICE_BYTES):
            for text in batch.column(batch.schema.get_field_index("text")):
                found.update(buckets_of(words_of(text.as_py()), longest, buckets))
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())],
                ["bucket", "n"],
            )

    counted = map_arrow(texts.select("text"), work, "bucket int, n long").groupBy("bucket")
    return {r["bucket"]: r["n"] for r in counted.agg(F.sum("n").alias("n")).collect()}


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Thousandths of the log ratio of smoothed shares, floored, per bucket."""
    of_raw, of_target = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return [
        math.floor(1000 * math.log((target.get(b, 0) + 1) * of_raw / ((raw.get(b, 0) + 1) * of_target)))
        for b in range(buckets)
    ]


def weighed(docs: DataFrame, gain: list[int], longest: int = LONGEST) -> DataFrame:
    """`doc_id, n_words, n_features, weight` of each row of `docs` (`doc_id, text`)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            sizes, features, weights = [], [], []
            for text in batch.column(batch.schema.get_field_index("text")):
                words = words_of(text.as_py())
                found = buckets_of(words, longest, len(gain))
                n = found.total()
                sizes.append(len(words))
                features.append(n)
                weights.append(sum(gain[b] * times for b, times in found.items()) // n if n else 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    *(pa.array(a, pa.int64()) for a in (sizes, features, weights)),
                ],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    fields = f"doc_id {kind}, n_words long, n_features long, weight long"
    return map_arrow(docs.select("doc_id", "text"), work, fields)


def noise(doc_id, seed: str = SEED):
    """Thousandths of a Gumbel variable, floored, from 32 bits of a hash of the id's text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    uniform = (h.cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(uniform)))


def ranked(rows: DataFrame) -> DataFrame:
    """`row_id, rank` of each row of `rows` (`score, doc_id, row_id`), the highest score first."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row_id")]
    # Where a row lies: its range in the upper bits, its place there in the lower 33.
    placed = landed(
        rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
        .select("row_id", F.monotonically_increasing_id().alias("at")),
        "resample-order",
    ).select("row_id", F.shiftright("at", 33).alias("range"), F.expr("at & 8589934591L").alias("place"))
    # One row per shuffle partition.
    sizes = {r["range"]: r["n"] for r in placed.groupBy("range").agg(F.count("*").alias("n")).collect()}
    begins, before = [], 0
    for k in sorted(sizes):
        begins.append((k, before))
        before += sizes[k]
    offsets = rows.sparkSession.createDataFrame(begins, "range long, before long")
    return placed.join(F.broadcast(offsets), "range").select(
        "row_id", (F.col("before") + F.col("place") + 1).alias("rank")
    )


def resampled(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS,
    seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """`doc_id, n_features, weight, score, rank` of each row of `docs` (`doc_id, text`).

    `target` has `text`. `percent` of the documents with at least `least_words` words are
    drawn and ranked from 1; `rank` is null for the rest.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets), buckets)
    scored = landed(
        weighed(docs, gain, longest).withColumns(
            {"score": F.col("weight") + noise(F.col("doc_id"), seed), "row_id": F.monotonically_increasing_id()}
        ),
        "resample-scores",
    )
    able = scored.where(F.col("n_words") >= least_words)
    draw = percent * able.count() // 100
    places = ranked(able.select("score", "doc_id", "row_id")).where(F.col("rank") <= draw)
    return scored.join(places, "row_id", "left").select(
        "doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")
    )
