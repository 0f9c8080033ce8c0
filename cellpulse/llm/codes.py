"""Product codes of vectors: Lloyd rounds whose exact rescans are saved by norm-of-sum bounds.

A vector of integers is cut into equal parts; each part position has a codebook. A round
assigns every part to its nearest entry and replaces entries by the floored mean of their
parts. For each part two bounds are kept: at most so far to its own entry, at least so far to
any other. Each bound has the stamp of the round in which it was exact, and the history of
codebooks is retained, so a bound of round s moves by the true net displacement
|entry now - entry in round s| (the norm of the sum of its steps) and not by the sum of the
steps' norms. Where the bounds still part, the assignment stands; else the distance to the
own entry is computed first, and all entries are scanned only if that is not enough.
Bounds are rounded outwards to 32 bits and compared strictly, so ties and rounding always
end in an exact scan of integers.

A round is one pass without a shuffle: rows and bounds are written with their codes (80 bytes
a vector beside its integers for 8 parts), then at most parts * entries sums are taken in each
task before they are merged. Two paths of the shared folder are written in turn, so the
disk holds two rounds however many there are. The driver sees the codebooks only. A group of
equal vectors or labels is never gathered: means are sums of task sums.

Defined results: null vectors, and those with null, NaN or infinite components, are dropped;
rows with a null or repeated id are vectors of their own, in the order (id, components), null
ids last, when the first entries are chosen; fewer vectors than entries make shorter codebooks;
distance ties go to the lower entry; null labels are one label; other columns are not carried
over; an empty table gives no rows. All vectors must have as many components as
the first, a multiple of the parts, and components must keep squared distances inside
64 bits; a vector that breaks this ends the job with a message naming its size or value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import map_arrow
from cellpulse.plans.bounded import broadcast_if_small, scratch_path

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
# Components worked on at a time in a task.
CHUNK = 1 << 20
# Beyond the error of 64-bit sums, below that of bounds rounded to 32 bits.
SLACK = 1 + 1e-12
_STATE = "codes binary, upper binary, lower binary, stamps binary, error long"


def finite(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & ~bad)


def _up(distance: np.ndarray) -> np.ndarray:
    return np.nextafter(distance.astype(np.float32), np.float32(np.inf))


def _down(distance: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(distance.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def displacements(history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Net displacement of each entry since each round, and the greatest among all other entries.

    `history` is (rounds, parts, entries, width); both results are (rounds, parts, entries).
    """
    steps = (history[-1] - history).astype(np.float64)
    own = np.sqrt((steps**2).sum(-1)) * SLACK
    others = np.zeros_like(own)
    for e in range(own.shape[2]):
        rest = np.delete(own, e, axis=2)
        others[:, :, e] = rest.max(-1) if rest.shape[2] else 0.0
    return own, others


@dataclass
class Bounds:
    """Codes of n vectors, and bounds with their stamps; arrays are (n, parts), stamps (n, parts, 2)."""

    codes: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    stamps: np.ndarray

    @classmethod
    def unknown(cls, n: int, parts: int) -> Bounds:
        return cls(
            np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf, np.float32),
            np.zeros((n, parts), np.float32), np.zeros((n, parts, 2), np.uint8),
        )


def _squared(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    gap = parts - entries
    return np.einsum("...i,...i->...", gap, gap)


def reassign(vectors: np.ndarray, held: Bounds, history: np.ndarray) -> tuple[Bounds, int]:
    """Codes by the newest codebook, from bounds of earlier rounds; also how many parts were scanned.

    `vectors` is (n, parts, width) of 64-bit integers.
    """
    now, book = len(history) - 1, history[-1]
    own, others = displacements(history)
    part = np.arange(vectors.shape[1])
    upper = held.upper + own[held.stamps[:, :, 0], part, held.codes]
    lower = held.lower - others[held.stamps[:, :, 1], part, held.codes]
    codes, stamps = held.codes.copy(), held.stamps.copy()
    new_upper, new_lower = held.upper.copy(), held.lower.copy()
    scanned = 0
    for p in part:
        unsure = np.flatnonzero(~(upper[:, p] < lower[:, p]))
        if not len(unsure):
            continue
        near = np.sqrt(_squared(vectors[unsure, p], book[p][codes[unsure, p]]).astype(np.float64))
        new_upper[unsure, p], stamps[unsure, p, 0] = _up(near), now
        unsure = unsure[~(new_upper[unsure, p] < lower[unsure, p])]
        if not len(unsure):
            continue
        scanned += len(unsure)
        squares = _squared(vectors[unsure, p][:, None, :], book[p][None])
        best = squares.argmin(1)
        codes[unsure, p] = best
        at = np.arange(len(unsure))
        new_upper[unsure, p] = _up(np.sqrt(squares[at, best].astype(np.float64)))
        rest = squares.astype(np.float64)
        rest[at, best] = np.inf
        new_lower[unsure, p] = _down(np.sqrt(rest.min(1)))
        stamps[unsure, p] = now
    return Bounds(codes, new_upper, new_lower, stamps), scanned


def errors(vectors: np.ndarray, codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distance of each vector to its entries, summed over parts."""
    part = np.arange(vectors.shape[1])
    return _squared(vectors, book[part, codes]).sum(1)


def _vectors(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    ints = batch.column(batch.schema.get_field_index("ints")).flatten()
    return ints.to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, parts, -1)


def _rows_of(array: np.ndarray) -> pa.Array:
    """Each row of an array as bytes."""
    flat = np.ascontiguousarray(array).reshape(len(array), -1).view(np.uint8)
    return pa.array([row.tobytes() for row in flat], pa.binary())


def _array_of(batch: pa.RecordBatch, name: str, dtype, shape: tuple) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index(name)).to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(batch.num_rows, *shape)


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, CHUNK // width)
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def assigned(rows: DataFrame, history: np.ndarray) -> DataFrame:
    """`rows` (`vec_id, label, ints`, and the state of an earlier round if any) with the state of this round."""
    parts, width = history.shape[1], history.shape[1] * history.shape[3]
    fresh = "codes" not in rows.columns
    plain = ["vec_id", "label", "ints"]
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in plain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, width):
            vectors = _vectors(batch, parts)
            if fresh:
                held = Bounds.unknown(batch.num_rows, parts)
            else:
                held = Bounds(
                    _array_of(batch, "codes", np.uint8, (parts,)),
                    _array_of(batch, "upper", np.float32, (parts,)),
                    _array_of(batch, "lower", np.float32, (parts,)),
                    _array_of(batch, "stamps", np.uint8, (parts, 2)),
                )
            found, _ = reassign(vectors, held, history)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in plain]
            columns += [_rows_of(a) for a in (found.codes, found.upper, found.lower, found.stamps)]
            columns.append(pa.array(errors(vectors, found.codes, history[-1]), pa.int64()))
            names = [*plain, "codes", "upper", "lower", "stamps", "error"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(rows, work, f"{fields}, {_STATE}")


def summed(rows: DataFrame, book: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and component sums of the parts of each used (part, entry)."""
    parts, entries, width = book.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(parts * entries, np.int64)
        sums = np.zeros((parts * entries, width), np.int64)
        for batch in _chunks(batches, parts * width):
            vectors = _vectors(batch, parts)
            slot = _array_of(batch, "codes", np.uint8, (parts,)) + np.arange(parts) * entries
            counts += np.bincount(slot.ravel(), minlength=len(counts))
            np.add.at(sums, slot.ravel(), vectors.reshape(-1, width))
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used, pa.int32()), pa.array(counts[used], pa.int64()),
                    pa.array(sums[used].tolist(), pa.list_(pa.int64())),
                ],
                ["slot", "n", "sums"],
            )

    partial = map_arrow(rows.select("ints", "codes"), work, "slot int, n long, sums array<bigint>")
    totals = partial.groupBy("slot").agg(
        F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums")
    )
    # At most parts * entries rows.
    return {(r["slot"] // entries, r["slot"] % entries): (r["n"], r["sums"]) for r in totals.collect()}


def _in_turn(spark):
    """Writes to two paths in turn; what lay in the older one is replaced."""
    paths = [scratch_path(spark, f"vector-codes-{side}") for side in "ab"]

    def put(df: DataFrame) -> DataFrame:
        paths.reverse()
        df.write.mode("overwrite").parquet(paths[0])
        return spark.read.schema(df.schema).parquet(paths[0])

    return put


def compressed(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """Coded rows `vec_id, label, codes, error` and the last codebooks (parts, entries, width).

    `codes` has one byte per part; `error` is the squared distance in units of 1/scale.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    spark = vectors.sparkSession
    kept = finite(vectors, vector).select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("wide"),
    )
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "wide").limit(entries).collect()
    size = len(first[0]["wide"]) if first else parts
    if size == 0 or size % parts:
        raise ValueError(f"vectors of {size} components are not cut into {parts} parts")
    if any(len(r["wide"]) != size for r in first):
        raise ValueError(f"a vector needs {size} components; found {[len(r['wide']) for r in first]}")
    if rounds > 254:
        raise ValueError("a stamp is one byte: at most 254 rounds")
    most = min(isqrt((1 << 61) // size), (1 << 31) - 1)
    fits = (F.size("wide") == size) & F.forall("wide", lambda x: F.abs(x) <= most)
    message = F.concat(
        F.lit(f"a vector needs {size} components within {most / scale:g}; found "),
        F.size("wide").cast("string"), F.lit(" with "), F.array_max("wide").cast("string"),
    )
    ints = F.when(fits, F.col("wide").cast("array<int>")).otherwise(F.raise_error(message).cast("array<int>"))
    rows = kept.select("vec_id", "label", ints.alias("ints"))
    if not first:
        book = np.zeros((parts, 0, size // parts), np.int64)
        none = rows.select("vec_id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error"))
        return none.limit(0), book
    book = np.array([r["wide"] for r in first], np.int64).reshape(len(first), parts, -1).swapaxes(0, 1)
    history, put = [book], _in_turn(spark)
    state = put(assigned(rows, np.stack(history)))
    for _ in range(rounds):
        book = history[-1].copy()
        for (part, entry), (n, sums) in summed(state, book).items():
            book[part, entry] = [s // n for s in sums]
        history.append(book)
        state = put(assigned(state, np.stack(history)))
    return state.select("vec_id", "label", "codes", "error"), history[-1]


def books_digest(book: np.ndarray) -> str:
    """Hash of all components in order of part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def code_digests(vectors: DataFrame) -> DataFrame:
    """`vec_id, code, error, label_error, codebooks_sha256` of each kept row."""
    coded, book = compressed(vectors)
    # One row per label; broadcast only where counting shows that they are few.
    totals = broadcast_if_small(
        coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    )
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
        F.lit(books_digest(book)).alias("codebooks_sha256"),
    )
