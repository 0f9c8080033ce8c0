"""Document fingerprints as invertible Bloom lookup sketches, DataFrame operations only.

A text is the set of digests of its paragraphs: lines, and a line of more than
`PIECE_CHARS` characters in pieces of that length. A sketch has three tables of 2^level
cells; a digest goes into one cell of each, chosen by another 21 of its 63 bits, and adds
one to the cell's count, itself to the cell's key and its hash to the cell's check (both by
exclusive or). Sketches of two versions subtract cell by cell, so only the digests that
differ remain; cells with a single digest give it up, it is taken out of its other cells, and
so on. If cells remain, both sketches are made again four times as large. The digests
recovered on either side, with the sizes of the sets, give the likeness of the texts: shared
digests over all digests.

The fingerprint is the number of digests and the sketch of `BASE_LEVEL`, as text.

Work per text is sorting, and one search among the held cells for each cell, so a text of very many
different lines is slow. Defined results: a null text is empty; two empty texts have likeness 1; rows with the same id follow each
other by text; an empty table gives no rows; other columns are not carried over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.llm.common import count_at_most

PIECE_CHARS = 200
BASE_LEVEL = 3
TABLES = 3
BITS = 63
WINDOW_BITS = BITS // TABLES
RETRIES = 8
PEEL_ROUNDS = 40
BLOCKS_PER_PARTITION = 4
_LOW = f"{(1 << BITS) - 1}L"
_ZERO = "named_struct('n', 0, 'k', 0L, 'c', 0L)"
_NONE = "CAST(array() AS array<bigint>)"

# The functions below return SQL: an expression of this depth is parsed in one step.


def let(name: str, value: str, body: str) -> str:
    """`body` with `name` bound to `value`, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def digests(text: str) -> str:
    """Distinct 63-bit digests of the paragraphs of a text."""
    pieces = rf"regexp_extract_all(coalesce({text}, ''), r'[^\n]{{1,{PIECE_CHARS}}}\n?|\n', 0)"
    return f"array_distinct(transform({pieces}, p -> xxhash64(p) & {_LOW}))"


def _turned(value: str, by: str) -> str:
    """A 63-bit number with its leading `by` bits moved to the end."""
    return f"((shiftleft({value}, {by}) & {_LOW}) | shiftrightunsigned({value}, {BITS} - {by}))"


def _table(keys: str, level: str, number: int) -> str:
    """Cells of one table; keys and checks are those of the turned digests."""
    turned = f"sort_array(transform({keys}, d -> {_turned('d', str(number * WINDOW_BITS))}))"
    sorted_ = (
        "named_struct('keys', t,"
        f" 'at', transform(t, v -> shiftrightunsigned(v, {BITS} - {level})),"
        f" 'cells', shiftleft(1L, {level}))"
    )
    # Cells that hold something are runs of the sorted keys; these are their first places.
    firsts = "filter(sequence(0, size(x.keys) - 1), i -> i = 0 OR get(x.at, i) <> get(x.at, i - 1))"
    run = "slice(x.keys, i + 1, coalesce(get(f, j + 1), size(x.keys)) - i)"
    content = let(
        "r",
        run,
        "named_struct('n', size(r), 'k', aggregate(r, 0L, (a, v) -> a ^ v),"
        " 'c', aggregate(r, 0L, (a, v) -> a ^ xxhash64(v)))",
    )
    held = let(
        "f",
        firsts,
        f"named_struct('number', transform(f, i -> get(x.at, i)), 'content', transform(f, (i, j) -> {content}))",
    )
    dense = (
        "transform(sequence(0L, x.cells - 1),"
        f" c -> coalesce(get(y.content, int(array_position(y.number, c)) - 1), {_ZERO}))"
    )
    return let("t", turned, let("x", sorted_, let("y", held, dense)))


def sketch(keys: str, level: str) -> str:
    """All cells of the sketch of an array of digests, table after table; both are names."""
    tables = ", ".join(_table(keys, level, j) for j in range(TABLES))
    empty = f"array_repeat({_ZERO}, {TABLES} * shiftleft(1, {level}))"
    return f"CASE WHEN size({keys}) = 0 THEN {empty} ELSE concat({tables}) END"


def _given_up(count: int) -> str:
    """Digests of the cells of `s` that hold one digest of the side with this count."""
    back = f"(({BITS} - shiftright(i, level) * {WINDOW_BITS}) % {BITS})"
    pure = f"CASE WHEN c.n = {count} AND xxhash64(c.k) = c.c THEN {_turned('c.k', back)} END"
    return f"array_distinct(array_compact(transform(s.cells, (c, i) -> {pure})))"


def peeled(cells: str) -> str:
    """Struct of the digests only on the first side, only on the second, and if all came out.

    `level` is a name in scope. A round takes out all that single-digest cells give up.
    """
    lessened = (
        "transform(s.cells, (c, i) -> CASE WHEN get(q.less, i).n = 0 AND get(q.more, i).n = 0 THEN c"
        " ELSE named_struct('n', c.n - get(q.less, i).n + get(q.more, i).n,"
        " 'k', c.k ^ get(q.less, i).k ^ get(q.more, i).k,"
        " 'c', c.c ^ get(q.less, i).c ^ get(q.more, i).c) END)"
    )
    out = f"named_struct('less', {sketch('g.plus', 'level')}, 'more', {sketch('g.minus', 'level')})"
    going_on = (
        f"named_struct('cells', {let('q', out, lessened)}, 'plus', concat(s.plus, g.plus),"
        " 'minus', concat(s.minus, g.minus), 'still', false)"
    )
    found = f"named_struct('plus', {_given_up(1)}, 'minus', {_given_up(-1)})"
    stopped = "named_struct('cells', s.cells, 'plus', s.plus, 'minus', s.minus, 'still', true)"
    taken = f"CASE WHEN size(g.plus) + size(g.minus) = 0 THEN {stopped} ELSE {going_on} END"
    begin = f"named_struct('cells', {cells}, 'plus', {_NONE}, 'minus', {_NONE}, 'still', false)"
    return (
        f"aggregate(sequence(1, {PEEL_ROUNDS}), {begin},"
        f" (s, n) -> CASE WHEN s.still THEN s ELSE {let('g', found, taken)} END,"
        " s -> named_struct('plus', s.plus, 'minus', s.minus,"
        " 'whole', forall(s.cells, c -> c.n = 0 AND c.k = 0 AND c.c = 0)))"
    )


def difference() -> str:
    """Struct `plus, minus, whole` of the digests in which the sets `w.a` and `w.b` differ.

    Tried with small sketches first, four times as large after each failure. The first
    size already holds the difference of the sets' sizes.
    """
    base = f"greatest({BASE_LEVEL}, length(bin(abs(size(w.a) - size(w.b)))))"
    level = f"least({base} + 2 * retry, {WINDOW_BITS - 1})"
    subtracted = (
        f"zip_with({sketch('w.a', 'level')}, {sketch('w.b', 'level')}, (c, e) ->"
        " named_struct('n', c.n - e.n, 'k', c.k ^ e.k, 'c', c.c ^ e.c))"
    )
    attempt = let("level", level, peeled(subtracted))
    nothing = f"named_struct('plus', {_NONE}, 'minus', {_NONE}, 'whole', false)"
    return (
        f"aggregate(sequence(0, {RETRIES - 1}), {nothing},"
        f" (o, retry) -> CASE WHEN o.whole THEN o ELSE {attempt} END)"
    )


def likeness(a: str, b: str) -> str:
    """Shared digests over all digests of two sets, from their sketches' difference."""
    # A difference beyond the largest sketch is counted outright.
    share = (
        "CASE WHEN size(w.a) + size(w.b) = 0 THEN 1D"
        " WHEN z.whole THEN (size(w.a) - size(z.plus)) / double(size(w.a) + size(z.minus))"
        " ELSE size(array_intersect(w.a, w.b)) / double(size(array_union(w.a, w.b))) END"
    )
    return let("w", f"named_struct('a', {a}, 'b', {b})", let("z", difference(), share))


def fingerprint(keys: str) -> str:
    """The number of digests and the cells of the base sketch as text, empty cells as `-`."""
    cell = "CASE WHEN c.n = 0 THEN '-' ELSE concat_ws(':', c.n, hex(c.k), hex(c.c)) END"
    cells = f"transform({sketch('m', str(BASE_LEVEL))}, c -> {cell})"
    return let("m", keys, f"concat(size(m), ';', array_join({cells}, ','))")


def with_next(docs: DataFrame) -> DataFrame:
    """`doc_id, text, next_text`: null texts empty, the next by ascending id, the first after the last.

    The ids are cut at their quantiles into blocks, each sorted by one task. The first
    text of each block, looked up by its id, follows the last of the block before.
    """
    spark = docs.sparkSession
    blocks = BLOCKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = F.percentile_approx("doc_id", [k / blocks for k in range(1, blocks)], 10 * blocks)
    edges = sorted(set(docs.agg(quantiles.alias("q")).first()["q"] or []))
    block = count_at_most(F.array(*map(F.lit, edges)), F.col("doc_id"), len(edges)) if edges else F.lit(0)
    texts = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(block).alias("block"),
    )
    # One id for each block that has rows.
    least = sorted(
        (r["block"], r["low"]) for r in texts.groupBy("block").agg(F.min("doc_id").alias("low")).collect()
    )
    if not least:
        return texts.select("doc_id", "text", F.col("text").alias("next_text"))
    # The block whose last row each block's first text follows.
    before = {nb: least[i - 1][0] for i, (nb, _) in enumerate(least)}
    lows = [low for _, low in least if low is not None]
    firsts = (
        texts.where(F.col("doc_id").isin(lows) | F.col("doc_id").isNull())
        .groupBy("block", "doc_id").agg(F.min("text").alias("_first"))
    ).select(
        F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("block")].alias("block"),
        "_first",
    )
    inside = Window.partitionBy("block").orderBy("doc_id", "text")
    return (
        texts.withColumn("_lead", F.lead("text").over(inside))
        .join(firsts, "block", "left")
        .select("doc_id", "text", F.coalesce("_lead", "_first").alias("next_text"))
    )


def version_prints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of `docs` (`doc_id, text`) and of its edited version.

    The edited version's second half is the beginning of the next document. Returns
    `doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`.
    """
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), chars - half), F.substring("next_text", F.lit(1), half))
    versions = with_next(docs).withColumn("edited", edited).selectExpr(
        "doc_id", "bigint(length(text)) AS n_chars", "sha2(edited, 256) AS edited_sha256",
        f"{digests('text')} AS a", f"{digests('edited')} AS b", f"{digests('next_text')} AS c",
    )
    return versions.selectExpr(
        "doc_id", "n_chars", "edited_sha256",
        f"{fingerprint('a')} AS fingerprint", f"{fingerprint('b')} AS edited_fingerprint",
        f"{likeness('a', 'b')} AS near_edited", f"{likeness('a', 'c')} AS near_next",
    )
