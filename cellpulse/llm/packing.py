"""Packing documents into fixed windows by non-negative least squares.

A document's ids, ended by an id of its own, fill whole windows as often as they can;
what is left is its remainder. The remainders' lengths make a histogram. Shallow
combinations of two or three lengths that fill a window exactly are enumerated, and
non-negative least squares finds how often to repeat each so that together they use up the
histogram; repeat counts are rounded down, and the n-th remainder of a length goes to the
n-th place for it. The residual is packed greedily: remainders are laid end to end and cut
at window ends, so only the last window is padded.

The histogram has one row per length at most, and so is all that the driver sees. Ranks
within a length, and running totals, are taken per bin of a hash order with bin totals
carried in, so a length with a third of all documents is spread over tasks.

Defined results: a null text is empty and has the end id only; repeated rows are documents
of their own; an empty table gives no rows; other columns are not carried over.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import hash_bin, landed, map_arrow, order_bins, running_before, slices

WINDOW = 1024
END_ID = 0
SLICE_BYTES = 1_000_000
# Words of a generation of those whose ids a worker keeps at hand; longer words are not kept.
CACHED_WORDS, CACHED_CHARS = 300_000, 100
# Columns of the least squares problem: combinations over the most frequent lengths.
TRIPLES = 600
SWEEPS, TOLERANCE = 200, 1e-4


# A byte-level tokenizer shows bytes as characters: printable ones of Latin-1 as themselves, the
# others, in order, by the characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPACE = "Ġ"
_SHOWN = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
# Letters, digits and white space of the Latin blocks, on which all versions of Unicode agree.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼-¾", "\t\n\v\f\r \x85\xa0"
# How a byte-level tokenizer cuts a text into words, in these blocks.
_WORDS = re.compile(
    rf"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
# Other characters than these blocks' and general punctuation.
_BEYOND = re.compile(r"[^\t\n\v\f\r -~\x85\xa0-\u024f\u2010-\u2027\u2030-\u205e]")


class KnownWords(dict):
    """Ids of words as little-endian 32-bit numbers; a word that is not there is encoded when asked for."""

    def __init__(self, encode, older: dict[str, bytes]):
        self.encode, self.older = encode, older

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= CACHED_CHARS:
            self[word] = ids
        return ids


class WordEncoder:
    """A tokenizer, and the ids of the words it has met.

    Two generations of words are kept: when the younger is full it becomes the older, and words
    met again move to the new younger one, so frequent words stay and rare ones go.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        split = self.tokenizer.pre_tokenizer
        # Only this way of splitting is known to keep words apart.
        plain = isinstance(split, ByteLevel) and split.use_regex and not split.add_prefix_space
        self.by_words = plain and self.tokenizer.normalizer is None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.known = KnownWords(self.word, {})

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word(self, word: str) -> bytes:
        """Ids of one word as the tokenizer cuts them, from its model."""
        if word.isascii() and word.isprintable():
            shown = _SPACE + word[1:] if word[0] == " " else word
        else:
            shown = word.encode().decode("latin-1").translate(_SHOWN)
        ids = [token.id for token in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def is_plain(self, text: str) -> bool:
        """Whether a text is cut into words here: Latin letters, no added token."""
        if not self.by_words or any(token in text for token in self.added):
            return False
        return (text.isascii() and text.isprintable()) or not _BEYOND.search(text)

    def cut(self, text: str) -> bytes:
        """Ids of a plain text."""
        return b"".join(map(self.known.__getitem__, _WORDS.findall(text)))

    def forget_rare(self) -> None:
        """Begin a new generation when the present one is full."""
        if len(self.known) > CACHED_WORDS:
            self.known.older = {}
            self.known = KnownWords(self.word, self.known)


@lru_cache(maxsize=1)
def encoder(path: str | None) -> WordEncoder:
    """One encoder per worker process and file, kept from task to task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return WordEncoder(path)


def encoded(texts: list[str], by: WordEncoder) -> list[bytes]:
    """Ids of each text as little-endian 32-bit numbers.

    Texts in Latin letters are cut into words by the tokenizer's own rule, and equal words are
    encoded once; other texts, and those that hold an added token, are encoded whole.
    """
    plain = [by.is_plain(t) for t in texts]
    whole = iter(by.whole([t for t, p in zip(texts, plain, strict=True) if not p]))
    out = [by.cut(t) if p else np.array(next(whole), "<u4").tobytes() for t, p in zip(texts, plain, strict=True)]
    by.forget_rare()
    return out


def tokenized(docs: DataFrame, tokenizer_path: str | None, window: int) -> DataFrame:
    """`doc_id, doc_tokens, window_crcs, rest, rest_crc, rest_ids` of each row of `docs` (`doc_id, text`).

    `window_crcs` has the checksum of each whole window, `rest_ids` the ids of the remainder.
    The tokenizer's file is named, or found on each executor when no path is given.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder(tokenizer_path)
        end, width = np.array([END_ID], "<u4").tobytes(), 4 * window
        for batch in slices(batches, "text", SLICE_BYTES):
            sizes, crcs, rests, rest_crcs = [], [], [], []
            for found in encoded(batch.column("text").fill_null("").to_pylist(), by):
                ids = found + end
                whole = len(ids) // width * width
                sizes.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + width]) for i in range(0, whole, width)])
                rests.append(ids[whole:])
                rest_crcs.append(zlib.crc32(ids[whole:]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int64()),
                    pa.array(crcs, pa.list_(pa.int64())),
                    pa.array([len(r) // 4 for r in rests], pa.int32()),
                    pa.array(rest_crcs, pa.int64()), pa.array(rests, pa.binary()),
                ],
                ["doc_id", "doc_tokens", "window_crcs", "rest", "rest_crc", "rest_ids"],
            )

    return map_arrow(
        docs.select("doc_id", "text"),
        encode,
        f"doc_id {kind}, doc_tokens long, window_crcs array<bigint>, rest int, rest_crc long,"
        " rest_ids binary",
    )


def combinations(histogram: dict[int, int], window: int) -> list[tuple[int, ...]]:
    """Sets of one to three lengths that fill a window, over lengths that occur.

    All pairs; of the triples those whose scarcest length is most frequent.
    """
    lengths = sorted(histogram)
    known = set(lengths)
    pairs = [(a, window - a) for a in lengths if a <= window - a and window - a in known]
    frequent = sorted(lengths, key=lambda n: (-histogram[n], n))[:128]
    triples = set()
    for i, a in enumerate(frequent):
        for b in frequent[i:]:
            if window - a - b in known:
                triples.add(tuple(sorted((a, b, window - a - b))))
    ranked = sorted(triples, key=lambda t: (-min(histogram[n] / t.count(n) for n in t), t))
    return pairs + ranked[:TRIPLES]


def least_squares(
    columns: np.ndarray, wanted: np.ndarray, sweeps: int = SWEEPS, tolerance: float = TOLERANCE
) -> np.ndarray:
    """Non-negative least squares by coordinate descent on the normal equations."""
    gram = columns.T @ columns
    x, slope = np.zeros(columns.shape[1]), -(columns.T @ wanted)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(x)):
            new = max(0.0, x[j] - slope[j] / gram[j, j])
            if new != x[j]:
                step = new - x[j]
                slope += step * gram[:, j]
                x[j] = new
                moved = max(moved, abs(step))
        if moved <= tolerance * max(1.0, x.max(initial=0.0)):
            break
    return x


def repeats(histogram: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations with whole repeat counts that never use more of a length than there is."""
    options = combinations(histogram, window)
    if not options:
        return []
    lengths = sorted(histogram)
    row = {n: i for i, n in enumerate(lengths)}
    columns = np.zeros((len(lengths), len(options)))
    for j, option in enumerate(options):
        for n in option:
            columns[row[n], j] += 1
    counts = np.array([histogram[n] for n in lengths], float)
    # In units of the mean count, rows weigh alike at every size of the corpus.
    solved = least_squares(columns, counts / counts.mean()) * counts.mean()
    left, out = dict(histogram), []

    def use(option: tuple[int, ...], times: int) -> int:
        times = min([times, *(left[n] // option.count(n) for n in option)])
        for n in option:
            left[n] -= times
        return times

    order = sorted(range(len(options)), key=lambda j: (-solved[j], options[j]))
    used = {j: use(options[j], int(solved[j] + 1e-6)) for j in order}
    # Rounding left some of each length; what still fits is used as well.
    for j in order:
        used[j] += use(options[j], max(histogram.values()))
    for j in order:
        if used[j]:
            out.append((options[j], used[j]))
    return out


def places(spark, solved: list[tuple[tuple[int, ...], int]], windows: int) -> tuple[DataFrame, int]:
    """Rows `rest, first, behind, base, at`: remainders of a length by rank, and where they go.

    The remainder of rank r goes to window base + r at offset `at`. Windows are numbered
    from `windows` on; the next free number is returned too.
    """
    rows, taken = [], {}
    for option, times in solved:
        at = 0
        for n in option:
            first = taken.get(n, 0)
            rows.append((n, first, first + times, windows - first, at))
            taken[n] = first + times
            at += n
        windows += times
    return spark.createDataFrame(rows, "rest int, first long, behind long, base long, at int"), windows


def packed(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of all rows of `docs` (`doc_id, text`) and their places.

    Returns `doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row_id`.
    """
    spark = docs.sparkSession
    rows = landed(
        tokenized(docs, tokenizer_path, window).withColumns(
            {"row_id": F.monotonically_increasing_id()}
        ),
        "packing-tokens",
    )
    bits = order_bins(spark)
    # The row number keeps rows of one id, or of none, apart.
    slim = rows.drop("rest_ids").withColumn("_hash", F.xxhash64("doc_id", "row_id"))
    slim = slim.withColumn("_bin", hash_bin(F.col("_hash"), bits))
    order = ["_hash", "row_id"]

    rests = slim.where("rest > 0").select("row_id", "rest", "_hash", "_bin")
    # At most `window` rows.
    sums = slim.groupBy("rest").agg(
        F.count("*").alias("rows"), F.sum(F.size("window_crcs")).alias("windows")
    ).collect()
    histogram = {r["rest"]: r["rows"] for r in sums if r["rest"]}
    # Windows are numbered from 0: whole ones, then the combinations', then the residual's.
    whole_windows = sum(r["windows"] for r in sums)
    where, behind = places(spark, repeats(histogram, window), whole_windows)
    ranked = running_before(
        rests.withColumn("_one", F.lit(1)), ["rest"], "_bin", order, {"rank": "_one"}
    )
    # At most three rows per combination.
    placed = ranked.join(F.broadcast(where.withColumnRenamed("rest", "_rest")),
        (F.col("rest") == F.col("_rest")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("behind")),
        "left",
    )
    matched = placed.where("base IS NOT NULL").select(
        "row_id", F.lit(0).alias("skip"), F.col("rest").alias("length"),
        (F.col("base") + F.col("rank")).alias("sequence_id"), F.col("at").alias("offset"),
    )
    # The rest end to end, cut where a window ends.
    laid = running_before(
        placed.where("base IS NULL").select("row_id", "rest", "_hash", "_bin"),
        [], "_bin", order, {"begin": "rest"},
    )
    residual = laid.select(
        "row_id", "rest", "begin",
        F.expr(f"explode(sequence(begin div {window}, (begin + rest - 1) div {window}))").alias("w"),
    ).select(
        "row_id",
        F.expr(f"CAST(greatest(begin, w * {window}) - begin AS INT)").alias("skip"),
        F.expr(
            f"CAST(least(begin + rest, (w + 1) * {window}) - greatest(begin, w * {window}) AS INT)"
        ).alias("length"),
        (F.col("w") + behind).alias("sequence_id"),
        F.expr(f"CAST(greatest(begin, w * {window}) % {window} AS INT)").alias("offset"),
    )
    tails = matched.unionByName(residual).join(
        rows.select("doc_id", "row_id", "doc_tokens", "rest", "rest_crc", "rest_ids"), "row_id"
    )

    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("skip", "length", "rest", "rest_crc", "rest_ids")]
            crcs = [
                crc if n == rest else zlib.crc32(ids[4 * skip : 4 * (skip + n)])
                for skip, n, rest, crc, ids in zip(*columns, strict=True)
            ]
            kept = [n for n in batch.schema.names if n in tail_columns]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(crcs, pa.int64())], [*kept, "ids_crc32"]
            )

    tail_columns = ("doc_id", "row_id", "doc_tokens", "skip", "length", "rest", "sequence_id", "offset")
    fields = ", ".join(f"{c} {dict(tails.dtypes)[c]}" for c in tails.columns if c in tail_columns)
    tails = map_arrow(tails, checksums, f"{fields}, ids_crc32 long").select(
        "doc_id", (F.col("doc_tokens") - F.col("rest") + F.col("skip")).alias("start"),
        F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        F.col("sequence_id").cast("long").alias("sequence_id"),
        F.col("offset").cast("long").alias("offset"), "row_id",
    )

    full = slim.withColumn("windows", F.size("window_crcs")).where("windows > 0")
    numbered = running_before(
        full.select("doc_id", "row_id", "doc_tokens", "window_crcs", "windows", "_hash", "_bin"),
        [], "_bin", order, {"before": "windows"},
    ).select("doc_id", "row_id", "doc_tokens", "before", F.posexplode("window_crcs").alias("nth", "ids_crc32"))
    wholes = numbered.select(
        "doc_id", (F.col("nth") * window).cast("long").alias("start"),
        F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("before") + F.col("nth")).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), "row_id",
    )
    return wholes.unionByName(tails)
