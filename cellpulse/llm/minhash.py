"""Near-duplicate detection with DartMinHash signatures.

A text is a weighted set: its shingles of five words, each with weight 1 (or its count).
Every element owns a strip of the plane of weights and ranks, and darts fall on it as hashes
of the element say, one per unit of area on average. A set sees the darts below its
weights; it needs about t = k ln k + 2k of them, so it looks at ranks up to t over its total
weight only, and further where a coordinate stays empty. A dart's hash names one of k
coordinates, and each coordinate keeps its dart of the least rank. Two sets agree in a
coordinate with the probability of their weighted Jaccard similarity, and a signature costs
about as many hashes as the set has elements plus t.

Equal texts are one class from the start, so a group of copies of any size is one row
afterwards. The signatures of the distinct texts are cut into bands; texts that share a
band meet in a bucket. Buckets are never expanded into pairs: every text is compared with
one leader, first the bucket's least id, then the text that so far has most links. What is
then left are buckets that still hold several components. Their texts of different components
are paired only where the rarest shingles of both leave room for a link. All comparisons are exact (set Jaccard of the shingles), and
links of `SIMILARITY` or more join classes.

With 24 bands of 5 rows, two texts of similarity 0.8 meet with probability 0.99993, of 0.85
with 0.9999992.

Defined results: a text of one to four words is one shingle; texts without words are like
equal texts only, null texts like nothing; rows with the same id are joined by it, with all
that their texts are close to; a null id joins nothing, and its text is compared like any
other; an empty table gives no rows; other columns are not carried over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import landed, map_arrow, slices
from cellpulse.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
SLICE_BYTES = 400_000
LEADER_ROUNDS = 2
_WORD = re.compile(r"[^ \t-\r]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers (the finishing steps of splitmix64)."""
    x = x + _MULTIPLIER
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles, text of each), text after text, hashes ascending."""
    words = [_WORD.findall(text) if text else [] for text in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.array([x for w in words for x in w], object)
    if not len(flat):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = pd.util.hash_array(flat, categorize=False)
    owner = np.repeat(np.arange(len(texts)), sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(flat)) - begin
    length = np.minimum(sizes, SHINGLE)[owner]
    rolled = np.zeros(len(flat), np.uint64)
    for k in range(SHINGLE):
        ahead = np.minimum(np.arange(len(flat)) + k, len(flat) - 1)
        step = mixed(rolled ^ hashes[ahead])
        rolled = np.where(k < length, step, rolled)
    # The last words of a text begin no shingle, but for a text shorter than one.
    starts = place <= sizes[owner] - length
    rolled, owner = rolled[starts], owner[starts]
    order = np.lexsort((rolled, owner))
    rolled, owner = rolled[order], owner[order]
    new = np.append(True, (rolled[1:] != rolled[:-1]) | (owner[1:] != owner[:-1]))
    return rolled[new], owner[new]


_DART_SHARES = np.cumsum([np.exp(-1) / np.prod(np.arange(1, n + 1), initial=1.0) for n in range(20)])


def darts(
    elements: np.ndarray, owner: np.ndarray, strip: np.ndarray, unit: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, rank, weight) of the darts in unit squares of weight `strip` and rank `unit`.

    The number in a square is Poisson with mean 1; all follows from the hash of (element, square).
    """
    seed = mixed(mixed(elements ^ mixed(strip.astype(np.uint64))) ^ mixed(unit.astype(np.uint64) + np.uint64(1 << 32)))
    uniform = (seed >> np.uint64(11)).astype(np.float64) / 2**53
    count = np.searchsorted(_DART_SHARES, uniform, side="right")
    at = np.repeat(np.arange(len(seed)), count)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    dart = mixed(seed[at] ^ mixed(nth.astype(np.uint64) + np.uint64(1 << 33)))
    rank = unit[at] + (dart >> np.uint64(11)).astype(np.float64) / 2**53
    other = mixed(dart)
    weight = strip[at] + (other >> np.uint64(11)).astype(np.float64) / 2**53
    return dart, owner[at], rank, weight


def signatures(
    elements: np.ndarray, owner: np.ndarray, n: int, k: int, weights: np.ndarray | None = None
) -> np.ndarray:
    """n signatures of k coordinates: for each the hash of its earliest dart, 0 for empty sets."""
    weights = np.ones(len(elements)) if weights is None else weights
    mass = np.bincount(owner, weights, minlength=n)
    needed = k * np.log(k) + 2 * k
    reach = np.ceil(needed / np.maximum(mass, 1e-300))
    earliest = np.full((n, k), np.inf)
    out = np.zeros((n, k), np.uint64)
    seen = np.zeros(n)
    # Strips of unit weight; the darts above an element's weight are not seen.
    strips = np.ceil(weights).astype(np.int64)
    element = np.repeat(np.arange(len(elements)), strips)
    strip = np.arange(len(element)) - np.repeat(np.cumsum(strips) - strips, strips)
    waiting = mass > 0
    while waiting.any():
        active = element[waiting[owner[element]]]
        layers = (reach - seen)[owner[active]].astype(np.int64)
        at = np.repeat(np.arange(len(active)), layers)
        unit = np.arange(len(at)) - np.repeat(np.cumsum(layers) - layers, layers)
        own = owner[active][at]
        dart, dart_owner, rank, weight = darts(
            elements[active][at], np.arange(len(at)), strip[waiting[owner[element]]][at], unit + seen[own]
        )
        fits = weight < weights[active][at][dart_owner]
        dart, dart_owner, rank = dart[fits], own[dart_owner[fits]], rank[fits]
        cell = dart_owner * k + (mixed(dart ^ np.uint64(1 << 34)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((dart, rank, cell))
        cell, rank, dart = cell[order], rank[order], dart[order]
        first = np.append(True, cell[1:] != cell[:-1])[: len(cell)]
        cell, rank, dart = cell[first], rank[first], dart[first]
        better = rank < earliest.ravel()[cell]
        earliest.ravel()[cell[better]] = rank[better]
        out.ravel()[cell[better]] = dart[better]
        # Ranks up to `reach` are seen now; empty coordinates need later darts.
        seen[waiting] = reach[waiting]
        waiting &= np.isinf(earliest).any(axis=1)
        reach[waiting] *= 2
    return out


def banded(docs: DataFrame) -> DataFrame:
    """`row, doc_id, told, bands` of each row of `docs` (`row, doc_id, text`).

    `told` is a digest that tells texts apart, null for null; texts without words have no bands.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = batch.column("text").to_pylist()
            elements, owner = shingles(texts)
            drawn = signatures(elements, owner, len(texts), BANDS * ROWS)
            drawn = drawn.reshape(len(texts), BANDS, ROWS)
            band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(texts), BANDS))
            for row in range(ROWS):
                band = mixed(band ^ drawn[:, :, row])
            some = np.bincount(owner, minlength=len(texts)) > 0
            keys = [b.tolist() if s else [] for b, s in zip(band.view(np.int64), some, strict=True)]
            told = [None if t is None else hashlib.sha256(t.encode()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("doc_id"), pa.array(told, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["row", "doc_id", "told", "bands"],
            )

    return map_arrow(
        docs.select("row", "doc_id", "text"), sign,
        f"row bigint, doc_id {kind}, told binary, bands array<bigint>",
    )


def shingle_sets(docs: DataFrame) -> DataFrame:
    """`row, shingles`: the distinct shingle hashes of each row."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            elements, owner = shingles(batch.column("text").to_pylist())
            ends = np.cumsum(np.bincount(owner, minlength=batch.num_rows))
            sets = pa.ListArray.from_arrays(
                pa.array(np.append(0, ends).astype(np.int32)), pa.array(elements.view(np.int64))
            )
            yield pa.RecordBatch.from_arrays([batch.column("row"), sets], ["row", "shingles"])

    return map_arrow(docs.select("row", "text"), gather, "row bigint, shingles array<bigint>")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (`a, b`) whose shingle sets have a Jaccard similarity of SIMILARITY or more."""
    left = sets.select(F.col("row").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("row").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    sizes = F.size("x") + F.size("y")
    # Exact in whole numbers: shared / (sizes - shared) >= 4 / 5.
    close = shared * 100 >= (sizes - shared) * int(SIMILARITY * 100)
    # Sets of too different sizes can't be close.
    near = F.least(F.size("x"), F.size("y")) * 100 >= F.greatest(F.size("x"), F.size("y")) * int(
        SIMILARITY * 100
    )
    return pairs.join(left, "a").join(right, "b").where(near).where(close).select("a", "b")


def possible_links(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (`a, b`) of texts (`rep, component`) of different components that can be close.

    Each set is ordered with its rarest shingles first. Two close sets share one of the
    first few of each (the prefix), and after the first one they share both have enough
    left. Only pairs that pass are made; they are exactly those which these bounds do not
    rule out, so no close pair is lost.
    """
    words = texts.join(sets, texts.rep == sets.row).select(
        "rep", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("s")
    )
    common = words.groupBy("s").agg(F.count("*").alias("df"))
    ordered = (
        words.join(common, "s")
        .groupBy("rep", "component", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("all"))
    )
    least = int(SIMILARITY * 100)
    # n - ceil(least * n / 100) + 1, in whole numbers.
    prefix = F.expr(f"CAST(n - (n * {least} + 99) div 100 + 1 AS INT)")
    rows = landed(
        ordered.select(
            "rep", "component", "n", F.posexplode(F.slice("all", F.lit(1), prefix)).alias("at", "word")
        )
        .where("word.df > 1")
        .select("rep", "component", "n", "at", "word.s"),
        "dedup-prefixes",
    )
    per = rows.groupBy("s", "component").agg(F.count("*").alias("rows"))
    several = per.groupBy("s").agg(
        F.max(F.struct("rows", "component")).alias("most"), F.count("*").alias("components")
    ).where("components > 1")
    # Landed, so that each join has two plain shuffles and a very common shingle can be split.
    largest = landed(several.select("s", F.col("most.component").alias("largest")), "dedup-shared")
    told = landed(rows.join(largest, "s"), "dedup-told")
    # Of each shingle's largest component only the other side of a pair is taken.
    x = told.where("component <> largest").select(
        "s", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("at").alias("ia")
    )
    y = told.select(
        "s", F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("ib")
    )
    enough = (100 + least) * F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= least * (
        F.col("na") + F.col("nb")
    )
    pairs = x.join(y, (x.s == y.s) & (F.col("ca") != F.col("cb")) & enough)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _placed(docs: DataFrame) -> DataFrame:
    """`row, doc_id, node, component, rep_id, class_id, class_digest` of each row of `docs`
    (`row, doc_id, text`, landed, each row number once).

    A node is the least row of the equal texts, a row itself where the text is null, and a
    component the least node of the class.
    """
    signed = landed(banded(docs), "dedup-bands")
    # Equal texts first, so that a group of copies is one text from here on.
    # Landed, so that the join has two plain shuffles and a hot text's partition can be split.
    equal = landed(
        signed.where("told IS NOT NULL")
        .groupBy("told")
        .agg(F.min("row").alias("node"), F.min("doc_id").alias("rep_id")),
        "dedup-equal",
    )
    # Null texts are apart, so that they do not meet in one task of the join.
    blank = signed.where("told IS NULL").select(
        "row", "doc_id", "told", F.col("row").alias("node"), F.col("doc_id").alias("rep_id")
    )
    members = landed(
        signed.select("row", "doc_id", "told")
        .join(equal, "told")
        .select("row", "doc_id", "told", "node", "rep_id")
        .unionByName(blank),
        "dedup-members",
    )
    # An id of several texts links each of them to its least one.
    repeated = landed(
        members.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("node").alias("a"), F.max("node").alias("most"))
        .where("a <> most")
        .select("doc_id", "a"),
        "dedup-repeated",
    )
    same_id = landed(
        members.join(repeated, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct(),
        "dedup-same-id",
    )
    reps = equal.select(F.col("node").alias("row"))
    bands = signed.select("row", "bands").join(reps, "row", "left_semi")
    rows = bands.select(F.explode("bands").alias("bucket"), F.col("row").alias("rep"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).where("n > 1")
    buckets = landed(rows.join(shared, "bucket").select("bucket", "rep", "leader").distinct(), "dedup-buckets")
    candidates = buckets.select(F.col("rep").alias("row")).distinct()
    sets = landed(
        shingle_sets(docs.select("row", "text").join(candidates, "row", "left_semi")), "dedup-sets"
    )

    def ordered(a, b):
        return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")

    tried = landed(
        buckets.where("rep <> leader").select(*ordered(F.col("rep"), F.col("leader"))).distinct(),
        "dedup-tried",
    )
    links = landed(linked(tried, sets), "dedup-links")
    for _ in range(LEADER_ROUNDS - 1):
        ends = links.select(F.explode(F.array("a", "b")).alias("rep"))
        degrees = ends.groupBy("rep").agg(F.count("*").alias("degree"))
        weighed = buckets.join(degrees, "rep", "left").select(
            "bucket", "rep", F.coalesce("degree", F.lit(0)).alias("degree")
        )
        best = weighed.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("rep")).alias("minus"))).alias("best"))
        more = (
            weighed.join(best.select("bucket", (-F.col("best.minus")).alias("leader")), "bucket")
            .where("rep <> leader")
            .select(*ordered(F.col("rep"), F.col("leader")))
            .distinct()
            .join(tried, ["a", "b"], "left_anti")
        )
        more = landed(more, "dedup-more")
        links = landed(links.unionByName(linked(more, sets)), "dedup-links")
        tried = tried.unionByName(more)

    # Texts of buckets that hold several components may still be close across these.
    found = components(links)
    placed = buckets.join(found, buckets.rep == found.node, "left").select(
        "bucket", "rep", F.coalesce("component", "rep").alias("component")
    )
    apart = (
        placed.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("bucket")
    )
    mixed_rows = landed(
        placed.join(apart, "bucket").select("rep", "component").distinct(), "dedup-mixed"
    )
    rest = possible_links(mixed_rows, sets).join(tried, ["a", "b"], "left_anti")
    last = landed(linked(landed(rest, "dedup-rest"), sets), "dedup-links")
    links = links.unionByName(last)
    joined = links.select("a", "b").unionByName(same_id)
    final = found if last.isEmpty() and same_id.isEmpty() else components(joined)
    # Least id and digest of the components of several nodes; the other nodes have their own.
    nodes = members.where("row = node").select("node", "rep_id", "told")
    named = landed(final.join(nodes, "node").select("node", "component", "rep_id", "told"), "dedup-nodes")
    whole = landed(
        named.groupBy("component").agg(F.min("rep_id").alias("class_id"), F.min("told").alias("class_told")),
        "dedup-classes",
    )
    of_node = landed(
        named.select("node", "component").join(whole, "component"), "dedup-named"
    )
    single = F.col("component").isNull()
    return members.join(of_node, "node", "left").select(
        "row", "doc_id", "node", F.coalesce("component", "node").alias("component"), "rep_id",
        F.when(single, F.col("rep_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.lower(F.hex(F.when(single, F.col("told")).otherwise(F.col("class_told")))).alias("class_digest"),
    )


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a number for each row, which stays the same since it is landed."""
    return landed(docs.withColumn(name, F.monotonically_increasing_id()), "dedup-documents")


def classes(docs: DataFrame) -> DataFrame:
    """`doc_id, class_id, rep_id, class_digest` of each row of `docs` (`doc_id, text`).

    `class_id` is the least id of the class, `rep_id` the least id of the equal texts, both null
    where no row of them has an id; `class_digest` is the least SHA-256 of the class's texts, which
    names a class without ids too. A row with neither an id nor a text is a class of its own.
    """
    return _placed(_numbered(docs.select("doc_id", "text"), "row")).select(
        "doc_id", "class_id", "rep_id", "class_digest"
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each class: one of the least id, or any where no row has an id.

    Rows with the same id are one class, so of an id with several texts one row stays.
    """
    numbered = _numbered(docs, "_dedup_row")
    kept = (
        _placed(numbered.select(F.col("_dedup_row").alias("row"), "doc_id", "text"))
        .where(F.col("class_id").eqNullSafe(F.col("doc_id")))
        .groupBy("component")
        .agg(F.min("row").alias("_dedup_row"))
        .select("_dedup_row")
    )
    return numbered.join(kept, "_dedup_row", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
