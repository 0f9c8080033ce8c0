"""URL filters by a sort-merge range join.

A host's labels in reverse, each followed by a dot, are its canonical key: a rule's
host and all its subdomains are then one interval of keys, and intervals of two rules are
nested or apart. Rules and URLs are cut at the same sampled splitters into buckets,
sorted by key, and swept once: a stack holds the rules whose interval is open. A rule
goes into each bucket that its interval meets; only intervals on one stack cross a
splitter, so the copies are at most splitters * stack depth. Nothing is broadcast, the
rule table may be of any size, and a host with a third of all rows is cut by path and row number.

Defined results: a null URL, or one without `://`, has an empty host and path and
meets no rule; of the rules that fit, the one with the most characters in host and
path wins, then the longer host, then `block`; URLs that no rule fits get `DEFAULT`;
repeated rows are judged one by one; ids of any type come back as they are, null ones too; other
columns are not carried over; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import landed, workers_import

DEFAULT = "allow"
SAMPLE_PER_BUCKET = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Follows the dot, so that `key + dot` up to `key + AFTER_DOT` holds all that begins with it.
AFTER_DOT = "/"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def host_key(host: Column) -> Column:
    """Labels in reverse, each with a dot after it; empty for an empty host."""
    reversed_ = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))
    return F.when(host == "", F.lit("")).otherwise(reversed_)


def _splitters(urls: DataFrame, buckets: int) -> list[tuple]:
    """Quantiles of a sample of about SAMPLE_PER_BUCKET places per bucket."""
    n = urls.count()
    fraction = min(1.0, buckets * SAMPLE_PER_BUCKET / max(n, 1))
    drawn = urls.where(
        F.xxhash64("row", F.lit("draw")).bitwiseAND(F.lit((1 << 32) - 1)) < int(fraction * 2**32)
    )
    places = sorted((r["key"], r["path"], r["salt"]) for r in drawn.select("key", "path", "salt").collect())
    return sorted({places[len(places) * k // buckets] for k in range(1, buckets)}) if places else []


class _Sweep:
    """Judges the URLs of sorted buckets; rules come before the URLs of the same key."""

    def __init__(self):
        self.bucket, self.stack = None, []

    def meet(self, bucket: int, key: str, is_url: bool, host: str, path: str, verdict: str | None):
        """Rule and verdict for a URL; nothing for a rule."""
        if bucket != self.bucket:
            self.bucket, self.stack = bucket, []
        stack = self.stack
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if not is_url:
            stack.append((key, host, path, verdict))
            return None
        fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for _, h, p, v in stack if path.startswith(p)]
        return max(fits, key=lambda f: f[:3])[3:] if fits else (None, None)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = _Sweep()
    for batch in batches:
        columns = (batch.column(batch.schema.get_field_index(c)) for c in ("bucket", "key", "is_url", "host", "path", "verdict"))
        judged = [sweep.meet(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)]
        kept = batch.filter(pa.array([j is not None for j in judged], pa.bool_()))
        rules, verdicts = ([j[i] for j in judged if j is not None] for i in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [
                *(kept.column(kept.schema.get_field_index(c)) for c in ("page_id", "host", "path")),
                pa.array(rules, pa.string()), pa.array(verdicts, pa.string()),
            ],
            ["page_id", "host", "path", "rule", "verdict"],
        )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """`page_id, host, path, rule, verdict` for each row of `pages` (`page_id, url`).

    `rules` has `host, path, verdict`; hosts in lower case.
    """
    spark = pages.sparkSession
    workers_import(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = pages.schema["page_id"].dataType
    # Landed with row numbers, by which rows of one host, path and id are still cut apart.
    urls = landed(
        pages.select(
            "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
            F.monotonically_increasing_id().alias("row"),
        ).withColumn("key", host_key(F.col("host"))),
        "url-keys",
    ).withColumn("salt", F.xxhash64("row", F.lit("salt")))
    edges = _splitters(urls, buckets)

    @F.pandas_udf("int")
    def bucket_of(key: pd.Series, path: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(edges, place) for place in zip(key, path, salt, strict=True)])

    @F.pandas_udf("array<int>")
    def buckets_of(key: pd.Series) -> pd.Series:
        low, high = -(1 << 63), (1 << 63) - 1
        return pd.Series(
            [
                list(range(
                    bisect_right(edges, (k, "", low)),
                    bisect_right(edges, (k[:-1] + AFTER_DOT, "", high)) + 1,
                ))
                for k in key
            ]
        )

    rows = urls.select(
        bucket_of("key", "path", "salt").alias("bucket"), "key", F.lit(True).alias("is_url"),
        "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"),
    )
    keyed = rules.where("host <> ''").select(host_key(F.col("host")).alias("key"), "host", "path", "verdict")
    opened = keyed.select(
        F.explode(buckets_of("key")).alias("bucket"), "key", F.lit(False).alias("is_url"),
        F.lit(None).cast(kind).alias("page_id"), "host", "path", "verdict",
    )
    swept = (
        rows.unionByName(opened)
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", "key", "is_url")
        .mapInArrow(
            _swept, f"page_id {kind.simpleString()}, host string, path string, rule string, verdict string"
        )
    )
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
