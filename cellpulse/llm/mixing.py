"""Mixing sources to target weights by a low-discrepancy schedule.

The words of a source, its documents in hash order, are one long stream, cut into
blocks of equal word counts. The schedule is a row of slots: slot i gets the
golden-ratio point frac(i / phi), the point is mapped through the cumulative
weights to a source, and the slot's rank among the source's slots names the block it
takes. Any run of slots is thus close to the target mixture. Each source gets exactly its
rounded number of slots: its last ones are left out, or further ones are put in over the whole
row, where the points miss it. Sources of few words have smaller blocks, so that every source
is due `LEAST_SLOTS` or blocks of one word. After its last block a source starts again, three
times at most.

Sources are taken to be catalogue entries: one row per source is held on the driver
(totals, weights, targets). Documents, blocks and slots stay distributed, and a source
with a third of all rows is spread over the bins of the hash order.

Defined results: null and blank texts have size 0 and are never taken; a null source is
a source of its own and comes last; repeated rows are documents of their own; an empty
table gives no rows. Columns of the input are not carried over, so none can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import (
    WORD,
    count_at_most,
    hash_bin,
    landed,
    order_bins,
    running_before,
    word_count,
)

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
# Slots of the whole schedule; a block holds about all words / SLOTS.
SLOTS = 65_536
# Slots that each source is due at least, so that rounding moves it little from its target.
LEAST_SLOTS = 256
SLOT_BIN = 4096
GOLDEN = 0.6180339887498949


@dataclass(frozen=True)
class Source:
    """One source: its size in words, what the mix should take, and its blocks."""

    number: int
    name: str | None
    size: int
    target: float
    blocks: int
    wanted: float


def targets(sizes: list[int], weights: list[float], most: int = MAX_REPEATS) -> list[float]:
    """Shares of the total by weight, none above `most` times its size.

    What a full source can't take is shared again by weight among the others.
    """
    left, open_ = float(sum(sizes)), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        per_weight = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if per_weight * weights[i] > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = per_weight * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ -= full
    return out


def plan_sources(
    totals: list[tuple[str | None, int]], weights: tuple[float, ...], slots: int
) -> list[Source]:
    """Targets and block counts; sources by code point, null last."""
    ordered = sorted(totals, key=lambda s: (s[0] is None, s[0] or ""))
    share = targets(
        [size for _, size in ordered], [weights[i % len(weights)] for i in range(len(ordered))]
    )
    block = max(1.0, sum(size for _, size in ordered) / slots)
    planned = []
    for number, ((name, size), target) in enumerate(zip(ordered, share, strict=True)):
        blocks = -int(-size // block) if size else 0
        if target > 0:
            blocks = max(blocks, -int(-LEAST_SLOTS * size // target))
        blocks = min(size, blocks)
        wanted = target * blocks / size if size else 0.0
        planned.append(Source(number, name, size, target, blocks, wanted))
    return planned


def due(source: Source) -> int:
    """The slots of a source."""
    return min(round(source.wanted), MAX_REPEATS * source.blocks)


def schedule(spark, planned: list[Source]) -> DataFrame:
    """`slot, source, rank` for all slots; each source has exactly the slots it is due."""
    sums, bounds = 0.0, []
    for s in planned:
        sums += s.wanted
        bounds.append(sums)
    n = round(sums)
    slots = spark.range(n).select(
        F.col("id").alias("_at"),
        # Exact enough in doubles: the fraction of i * golden keeps some 30 bits at 2^22 slots.
        ((F.col("id") + 0.5) * GOLDEN % 1.0 * sums).alias("_point"),
    )
    edges = F.array(*(F.lit(b) for b in bounds[:-1])) if len(bounds) > 1 else None
    number = count_at_most(edges, F.col("_point"), len(bounds) - 1) if edges is not None else F.lit(0)
    hit = slots.select(F.col("_at").cast("double"), number.cast("int").alias("source"))
    # One row per source, the same bound as that of the plan.
    hits = {r["source"]: r["count"] for r in hit.groupBy("source").count().collect()}
    short = [s.number for s in planned for _ in range(due(s) - hits.get(s.number, 0))]
    # Further slots go between the others, all over the row.
    more = [((k + 0.5) * GOLDEN % 1.0 * n, number) for k, number in enumerate(short)]
    placed = hit.unionByName(spark.createDataFrame(more, "_at double, source int")).withColumns(
        {"_bin": F.floor(F.col("_at") / SLOT_BIN).cast("int"), "_one": F.lit(1)}
    )
    ranked = running_before(placed, ["source"], "_bin", ["_at"], {"rank": "_one"})
    limit = F.array(*(F.lit(due(s)).cast("long") for s in planned))
    left = ranked.where(F.col("rank") < F.get(limit, F.col("source")))
    numbered = running_before(left, [], "_bin", ["_at", "source", "rank"], {"slot": "_one"})
    return numbered.select("slot", "source", "rank")


def document_streams(docs: DataFrame, planned: list[Source], sized: DataFrame) -> DataFrame:
    """Documents with `number` of the source and `begin`, their place in its stream."""
    spark = docs.sparkSession
    names = spark.createDataFrame(
        [(s.name, s.number) for s in planned], "_name string, number int"
    )
    # One row per source, the same bound as on the driver.
    placed = sized.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    bits = order_bins(spark)
    placed = placed.withColumn("_bin", hash_bin(F.col("_hash"), bits))
    return running_before(
        placed, ["number"], "_bin", ["_hash", "doc_id", "row_id"], {"begin": "size"}
    )


def _sized(docs: DataFrame) -> DataFrame:
    sized = landed(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"),
            F.xxhash64("doc_id", "text").alias("_hash"), F.monotonically_increasing_id().alias("row_id"),
        ),
        "mix-sizes",
    )
    # Rows without an id lie all over the order, by their row number.
    return sized.withColumn("_hash", F.when(F.col("doc_id").isNull(), F.xxhash64("row_id")).otherwise(F.col("_hash")))


def _plan(sized: DataFrame, weights: tuple[float, ...], slots: int) -> list[Source]:
    totals = [
        (r["source"], r["size"])
        for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    ]
    return plan_sources(totals, weights, slots)


def _streamed(docs: DataFrame, planned: list[Source], sized: DataFrame) -> DataFrame:
    def per_source(values: list, kind: str):
        return F.get(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("number"))

    return document_streams(docs, planned, sized).withColumns(
        {
            "source_size": per_source([s.size for s in planned], "long"),
            "target": per_source([s.target for s in planned], "double"),
            "_blocks": per_source([s.blocks for s in planned], "long"),
        }
    )


def _mixed(streamed: DataFrame, planned: list[Source]) -> DataFrame:
    """`slot, number, rank, pass, block, row_id, size, begin, words`: the pieces of each slot's block."""
    # Word w lies in block floor(w * blocks / size), so block k begins at ceil(k * size / blocks).
    pieces = streamed.where("size > 0").select(
        "row_id", "number", "begin", "size", "source_size", "_blocks",
        F.expr(
            "explode(sequence(begin * _blocks div source_size,"
            " (begin + size - 1) * _blocks div source_size))"
        ).alias("block"),
    )
    edge = "(({k} * source_size + _blocks - 1) div _blocks)"
    first = f"greatest(begin, {edge.format(k='block')})"
    pieces = pieces.select(
        "row_id", "number", "block", "size", F.expr(f"{first} - begin").alias("begin"),
        F.expr(f"least(begin + size, {edge.format(k='(block + 1)')}) - {first}").alias("words"),
    )
    count = F.get(F.array(*(F.lit(s.blocks).cast("long") for s in planned)), F.col("source"))
    slots = schedule(streamed.sparkSession, planned).select(
        "slot", F.col("source").alias("number"), "rank",
        F.expr("rank").alias("_rank"), count.alias("_count"),
    ).select(
        "slot", "number", "rank", F.expr("_rank div _count").alias("pass"), F.expr("_rank % _count").alias("block")
    )
    return pieces.join(slots, ["number", "block"])


def mixed_blocks(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, slots: int = SLOTS
) -> DataFrame:
    """The mix in its order: `slot, source, rank, pass, block, doc_id, row_id, size, begin, words`.

    One row for each document that lies in a slot's block: `words` words of it from word `begin`
    on, of its `size`. `row_id` tells rows of the same id apart; `pass` counts how often the source
    had ended before.
    """
    sized = _sized(docs)
    planned = _plan(sized, weights, slots)
    if not planned:
        zero = F.lit(0).cast("long")
        return sized.select(
            zero.alias("slot"), "source", zero.alias("rank"), zero.alias("pass"), zero.alias("block"),
            "doc_id", "row_id", "size", zero.alias("begin"), zero.alias("words"),
        )
    streamed = _streamed(docs, planned, sized)
    rows = _mixed(streamed.drop("source", "doc_id"), planned)
    return rows.join(sized.select("row_id", "source", "doc_id"), "row_id").select(
        "slot", "source", "rank", "pass", "block", "doc_id", "row_id", "size", "begin", "words"
    )


def mix_words(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, slots: int = SLOTS
) -> DataFrame:
    """What the mix takes of each document.

    `docs` has `doc_id, text, source`. Returns one row per row of it: `doc_id, size,
    source_size, target, taken, row_id`; taken counts words with repeats.
    """
    sized = _sized(docs)
    planned = _plan(sized, weights, slots)
    if not planned:
        empty = sized.withColumns(
            {"source_size": F.lit(0).cast("long"), "target": F.lit(0.0), "taken": F.lit(0).cast("long")}
        )
        return empty.select("doc_id", "size", "source_size", "target", "taken", "row_id")
    streamed = _streamed(docs, planned, sized)
    taken = _mixed(streamed, planned).groupBy("row_id").agg(F.sum("words").cast("long").alias("taken"))
    return streamed.join(taken, "row_id", "left").select(
        "doc_id", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "row_id",
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The documents of the mix with the columns of `docs`, one row for each time one is taken.

    Only the last document that a source's blocks reach can be taken in part; its text ends
    with the last word they reach, so the words of all rows are those of `mixed_blocks`. An
    `n_chars` of such a row is that of the text left. The order of the mix is in `mixed_blocks` only.
    """
    kept = landed(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "mix-documents")
    blocks = mixed_blocks(kept.select(F.col("_mix_row").alias("doc_id"), "text", "source"), weights)
    copies = blocks.groupBy(
        F.col("doc_id").alias("_mix_row"), F.col("pass").alias("_mix_pass"), F.col("size").alias("_mix_size")
    ).agg(F.sum("words").cast("int").alias("_mix_words"))
    in_part = F.col("_mix_words") < F.col("_mix_size")
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("_mix_words")), "")
    taken = kept.join(copies, "_mix_row").withColumn("text", F.when(in_part, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        chars = F.when(in_part & F.col("n_chars").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
        taken = taken.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return taken.select(*(F.col(f"`{c}`") for c in docs.columns))
