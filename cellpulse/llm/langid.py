"""Language identification by inference of a mixture of languages.

Each language is a model of letter n-grams: the log probability of a letter after the two
before it, counted on a bounded sample of labelled documents (`SAMPLE_PER_LANGUAGE`, drawn
by a hash of the id) and smoothed. A document is a mixture: each of its words comes from
one of the document's languages, and the languages' proportions are estimated by
expectation-maximisation from the words' n-gram likelihoods. Sets of one, two, ...
languages are compared by their likelihood less a penalty for each further language; the
predicted language is the one with the largest proportion in the best set. The score is
that proportion and, for a set of one, its posterior among the single languages.

Texts are read whole, in slices of bounded size. Defined results: null texts and texts
without a letter are `und` with score 0; without any labelled document all are `und`;
ties go to the language that sorts first; repeated rows are judged one by one; an empty
table gives no rows; other columns are not carried over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellpulse.llm.common import held_out, map_arrow, slices

SAMPLE_PER_LANGUAGE = 2_000
BUCKETS = 1 << 15
SMOOTHING = 0.5
ROUNDS = 12
# What a further language must gain in log likelihood, for each halving of 1 / words.
PENALTY = 2.0
# No word may speak more strongly against a language than this, so that one odd word decides nothing.
WORD_FLOOR = 12.0
SLICE_BYTES = 400_000
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")


def letter_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each letter with its two letters before, first letter of each word, words per text).

    Words are runs of letters, lowered, with a mark before and after; letters that lower to
    several are handled as those.
    """
    words = [_WORDS.findall(text.lower()) if text else [] for text in texts]
    # The pattern also takes numerals such as a superscript; they alone are no text.
    words = [w if any(c.isalpha() for x in w for c in x) else [] for w in words]
    per_text = np.array([len(w) for w in words], np.int64)
    joined = "".join(f"\x02{' '.join(w)} " for w in words if w)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
    codes[codes == 2] = 32  # the mark that opens a text is a gap as any other
    gap = codes == 32
    mixed = codes.astype(np.uint64)
    before = np.concatenate([[np.uint64(32)], mixed[:-1]])[: len(mixed)]
    # Nothing before a word's own mark counts.
    second = np.concatenate([[np.uint64(32), np.uint64(32)], mixed[:-2]])[: len(mixed)]
    second[before == 32] = 32
    hashed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ (before * np.uint64(0xC2B2AE3D27D4EB4F))
    hashed = (hashed ^ (second * np.uint64(0x165667B19E3779F9))) * np.uint64(0xFF51AFD7ED558CCD)
    buckets = (hashed >> np.uint64(49)).astype(np.int32) % BUCKETS
    # A word runs from its first letter to the gap behind it; the mark that opens a text is in none.
    mark = gap & (before == 32)
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1 if len(gap) else np.empty(0, np.int64)
    return buckets[~mark], starts - np.cumsum(mark)[starts], per_text


@dataclass(frozen=True)
class Model:
    """Languages in order, and log probabilities by bucket and language."""

    languages: tuple[str, ...]
    log_p: np.ndarray

    def word_likelihoods(self, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log likelihood of each word under each language."""
        if not len(starts):
            return np.empty((0, len(self.languages)))
        rows = self.log_p[buckets]
        sums = np.add.reduceat(rows, starts, axis=0, dtype=np.float64)
        return np.maximum(sums, sums.max(axis=1, keepdims=True) - WORD_FLOOR)


def learned(docs: DataFrame) -> Model:
    """n-gram models of the languages of `docs` (`doc_id, text, lang`), held-out rows left out."""
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model((), np.zeros((BUCKETS, 0), np.float32))
    # Rows without an id are drawn one by one.
    named = F.xxhash64("doc_id", F.lit("language sample"))
    numbered = F.xxhash64("_row", F.lit("language sample"))
    draw = F.when(F.col("doc_id").isNotNull(), named).otherwise(numbered).bitwiseAND(F.lit((1 << 32) - 1))
    limits = F.create_map(
        *(
            F.lit(x)
            for lang, n in counts.items()
            for x in (lang, int(min(1.0, SAMPLE_PER_LANGUAGE / n) * 2**32))
        )
    )
    labelled = labelled.withColumn("_row", F.monotonically_increasing_id())
    sample = labelled.where(draw < limits[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", SLICE_BYTES):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in set(langs):
                own = [t for t, other in zip(texts, langs, strict=True) if other == lang]
                found = np.bincount(letter_grams(own)[0], minlength=BUCKETS)
                sums[lang] = sums.get(lang, 0) + found
        for lang, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(found[at], pa.int64())],
                ["lang", "bucket", "n"],
            )

    # At most languages * BUCKETS rows.
    rows = (
        map_arrow(sample, count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    )
    languages = tuple(sorted(counts))
    table = np.zeros((BUCKETS, len(languages)))
    number = {lang: i for i, lang in enumerate(languages)}
    columns = [number[x] for x in rows.column("lang").to_pylist()]
    table[rows.column("bucket").to_numpy(), columns] = rows.column("n").to_numpy()
    table += SMOOTHING
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def _mixture(
    p: np.ndarray, owner: np.ndarray, firsts: np.ndarray, weights: np.ndarray, rounds: int
) -> tuple[np.ndarray, np.ndarray]:
    """EM over the words of several texts at once: proportions and log likelihood of each text.

    `p` has the words' scaled likelihoods, `owner` the text of each word, `firsts` each
    text's first word; languages with a starting weight of 0 stay out.
    """
    n = np.diff(np.append(firsts, len(p)))[:, None]
    for _ in range(rounds):
        shares = p * weights[owner]
        shares /= shares.sum(axis=1, keepdims=True)
        weights = np.add.reduceat(shares, firsts, axis=0) / n
    mixed = np.log(np.einsum("ij,ij->i", p, weights[owner]))
    return weights, np.add.reduceat(mixed, firsts)


def infer(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Predicted language, score and proportions (texts * languages) of each text."""
    k = len(model.languages)
    out, scores, proportions = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros((len(texts), k))
    buckets, starts, per_text = letter_grams(texts)
    some = np.flatnonzero(per_text)
    if not k or not len(some):
        return out, scores, proportions
    logs = model.word_likelihoods(buckets, starts)
    sizes = per_text[some]
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(some)), sizes)
    top = logs.max(axis=1, keepdims=True)
    p = np.exp(logs - top)
    # One language: the sum of its words' likelihoods.
    single = np.add.reduceat(logs - top, firsts, axis=0)
    best = single.max(axis=1)
    weights = np.zeros((len(some), k))
    weights[np.arange(len(some)), single.argmax(axis=1)] = 1.0
    if k > 1:
        full, _ = _mixture(p, owner, firsts, np.full((len(some), k), 1 / k), ROUNDS)
        order = np.argsort(-full, axis=1, kind="stable")
        value, trying = best.copy(), np.arange(len(some))
        for size in range(2, k + 1):
            # Only texts that gained from the language before it try one more.
            chosen = np.zeros((len(trying), k))
            np.put_along_axis(chosen, order[trying, :size], 1 / size, axis=1)
            tried = np.zeros(len(some), bool)
            tried[trying] = True
            inside = tried[owner]
            lengths = sizes[trying]
            at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            fit, likelihood = _mixture(
                p[inside], np.repeat(np.arange(len(trying)), lengths), at, chosen, ROUNDS // 2
            )
            gained = likelihood - PENALTY * (size - 1) * np.log1p(lengths) > value[trying]
            value[trying[gained]] = (likelihood - PENALTY * (size - 1) * np.log1p(lengths))[gained]
            weights[trying[gained]] = fit[gained]
            trying = trying[gained]
            if not len(trying):
                break
    main = weights.argmax(axis=1)
    against = single - single[np.arange(len(some)), main][:, None]
    posterior = 1 / np.exp(np.clip(against, -50, 50)).sum(axis=1)
    alone = (weights > 0).sum(axis=1) == 1
    sure = np.where(alone, posterior, weights.max(axis=1))
    for i, text in enumerate(some):
        out[text] = model.languages[main[i]]
    scores[some] = np.clip(sure, 0.0, 1.0)
    proportions[some] = weights
    return out, scores, proportions


def _judged(docs: DataFrame, model: Model, carried: list[str]) -> DataFrame:
    """`row` (a struct of the carried columns), `lang_pred, score, languages` of each row of `docs`."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            names, scores, shares = infer(model, batch.column("text").to_pylist())
            sets = [
                sorted(
                    ({"lang": model.languages[j], "share": float(row[j])} for j in np.flatnonzero(row)),
                    key=lambda x: -x["share"],
                )
                for row in shares
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), pa.array(names, pa.string()), pa.array(scores),
                    pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
                ],
                ["row", "lang_pred", "score", "languages"],
            )

    found = T.ArrayType(T.StructType().add("lang", T.StringType()).add("share", T.DoubleType()))
    out = T.StructType().add("row", rows.schema["row"].dataType).add("lang_pred", T.StringType())
    return map_arrow(rows, judge, out.add("score", T.DoubleType()).add("languages", found))


def identified(docs: DataFrame) -> DataFrame:
    """`doc_id, held_out, lang_pred, score, languages` of each row of `docs` (`doc_id, text, lang`).

    `languages` lists the selected set as (lang, proportion), largest first.
    """
    found = _judged(docs, learned(docs), ["doc_id"])
    return found.select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "languages"
    )


def with_known_language(docs: DataFrame, least_share: float = 0.0) -> DataFrame:
    """The rows of `docs` whose main language was recognised and has at least this proportion."""
    found = _judged(docs, learned(docs), docs.columns)
    main = F.get("languages", F.lit(0))["share"]
    return found.where((F.col("lang_pred") != UNKNOWN) & (main >= least_share)).select("row.*")
