"""Quality rules with risk-controlled thresholds, DataFrame operations only.

Each rule rejects a document whose measure exceeds a cutoff. The cutoffs come from
labelled documents: for each stratum (a class of lengths), rule and cutoff of a fixed
grid, the good documents beyond the cutoff are counted over the whole table, and the
cutoff counts as safe when the exact binomial bound says that at most `RISK` / rules of
good documents are beyond it, at confidence 1 - `MISS` shared equally (Bonferroni) among
all strata, rules and cutoffs. The strictest safe cutoff is used; without one the rule is
off in that stratum. So, with probability 1 - `MISS`, no stratum loses more than `RISK`
of its good documents to the learned rules.

The grid is fixed, so every labelled document is a holdout. The counts (strata * rules *
cutoffs numbers) are all that comes to the driver.

Defined results: null and blank texts have no words and fail the base rules; labels
that are null count as not good; repeated rows are judged one by one; an empty table
gives no rows; other columns are not carried over.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import GAP, landed, let, words_of

RISK = 0.02
MISS = 0.05
WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
# Strata: documents of up to this many words, and the rest.
STRATA = (200, 1000)


@dataclass(frozen=True)
class Rule:
    """A measure as SQL over the counts, and the cutoffs to try."""

    name: str
    measure: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / n_words", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5)),
    Rule("duplicate_lines", "n_dup_lines / n_lines", (0.05, 0.1, 0.2, 0.3, 0.5, 0.7)),
    Rule("repeated_words", "n_repeat_words / n_words", (0.02, 0.05, 0.1, 0.15)),
    Rule("long_words", "word_chars / n_words", (7.0, 8.0, 10.0, 12.0, 15.0)),
)


def repeated_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text.

    Each window becomes one long: a hash above its position. Sorting brings equal
    windows together; the union of their words is summed over sorted positions. Sorting
    and the two passes are linear in the text up to the sort.
    """
    ahead = range(1, WINDOW_WORDS)

    def windows(hashes: Column, bits: Column) -> Column:
        starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (WINDOW_WORDS - 1), F.lit(0)))
        return F.transform(
            starts,
            lambda h, i: F.call_function(
                "shiftleft", F.xxhash64(h, *(F.get(hashes, i + k) for k in ahead)), bits
            ).bitwiseOR(i.cast("long")),
        )

    def repeated(keys: Column, bits: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            shift = "shiftrightunsigned"
            return F.coalesce(
                F.call_function(shift, a, bits) == F.call_function(shift, b, bits), F.lit(False)
            )

        return F.filter(
            keys, lambda k, j: same(k, F.get(keys, j - 1)) | same(k, F.get(keys, j + 1))
        )

    def positions(keys: Column, bits: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        return F.array_sort(F.transform(keys, lambda k: k.bitwiseAND(mask)))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(-WINDOW_WORDS).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
            lambda s, p: F.struct(
                p.alias("last"),
                (s["n"] + F.least(p - s["last"], F.lit(WINDOW_WORDS).cast("long"))).alias("n"),
            ),
            lambda s: s["n"],
        )

    def counted(hashes: Column) -> Column:
        # Bits that hold every position.
        return let(
            F.length(F.bin(F.size(hashes))).cast("int"),
            lambda bits: let(
                F.sort_array(windows(hashes, bits)),
                lambda keys: covered(positions(repeated(keys, bits), bits)),
            ),
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), counted)


def text_counts(text: Column) -> Column:
    """Struct of the counts of one text."""
    whole = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(whole, GAP, "")
    lines = F.filter(F.split(whole, "\n"), lambda line: F.regexp_replace(line, GAP, "") != "")
    symbols = F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))
    return F.struct(
        F.length(bare).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        let(words_of(text), lambda w: F.struct(
            F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("w"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
    )


def measured(docs: DataFrame) -> DataFrame:
    """`doc_id` and the counts of each document."""
    counted = docs.select("doc_id", text_counts(F.col("text")).alias("c"))
    return counted.select(
        "doc_id", F.col("c.w.n").alias("n_words"), F.col("c.word_chars").alias("word_chars"),
        F.col("c.n_symbols").alias("n_symbols"), F.col("c.l.d").alias("n_dup_lines"),
        F.col("c.w.r").alias("n_repeat_words"), F.col("c.l.n").alias("n_lines"),
    )


def base_failed() -> Column:
    return F.expr(
        f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
    )


def stratum() -> Column:
    return F.lit(0) + sum(((F.col("n_words") > n).cast("int") for n in STRATA), F.lit(0))


def _ratio(measure: str) -> Column:
    above, below = measure.split(" / ")
    return F.coalesce(F.try_divide(F.col(above), F.col(below)), F.lit(0.0))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n), from the greatest term down; what is left out is bounded and added."""
    if k >= n:
        return 1.0
    if k >= n * p:
        return 1.0  # no bound below p is possible
    log_term = (
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    term = total = math.exp(log_term)
    for j in range(k, 0, -1):
        ratio = j * (1 - p) / ((n - j + 1) * p)
        term *= ratio
        total += term
        if term < total * 1e-17:
            # The ratios only fall, so a geometric sum bounds the rest.
            return min(1.0, total + term * ratio / (1 - ratio))
    return min(1.0, total)


def cutoffs_of(counts: DataFrame, labels: DataFrame, risk: float, miss: float) -> dict:
    """The strictest safe cutoff of each (stratum, rule number)."""
    good = labels.where("quality = 1").select("doc_id").distinct()
    judged = counts.where(~base_failed()).join(good, "doc_id", "left_semi")
    beyond = [
        F.sum((_ratio(rule.measure) > c).cast("long")).alias(f"b{i}_{j}")
        for i, rule in enumerate(RULES)
        for j, c in enumerate(rule.cutoffs)
    ]
    rows = judged.groupBy(stratum().alias("stratum")).agg(F.count("*").alias("n"), *beyond).collect()
    tests = (len(STRATA) + 1) * sum(len(rule.cutoffs) for rule in RULES)
    safe = {}
    for row in rows:
        for i, rule in enumerate(RULES):
            passing = [
                c
                for j, c in enumerate(rule.cutoffs)
                if binomial_tail(row[f"b{i}_{j}"], row["n"], risk / len(RULES)) <= miss / tests
            ]
            if passing:
                safe[row["stratum"], i] = min(passing)
    return safe


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, miss: float = MISS) -> DataFrame:
    """Counts and verdict of every row of `docs` (`doc_id, text`).

    `labels` has `doc_id, quality`. Returns `doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, rejected_by`.
    """
    counts = landed(measured(docs), "rule-counts")
    safe = cutoffs_of(counts, labels, risk, miss)
    hit = F.lit(None).cast("string")
    for (s, i), cutoff in sorted(safe.items(), reverse=True):
        trips = (stratum() == s) & (_ratio(RULES[i].measure) > cutoff)
        hit = F.when(trips, F.lit(RULES[i].name)).otherwise(hit)
    return counts.withColumn("base_failed", base_failed()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & hit.isNull()).alias("kept"), hit.alias("rejected_by"),
    )
