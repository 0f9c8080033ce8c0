"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.operators.mobility import neighbor_sets


def write_table(df: DataFrame, path: str, file_format: str = "parquet", **options) -> None:
    """Write a result as parquet, or as csv or json with the given options."""
    df.write.options(**options).format(file_format).save(path)


def write_cdf(distribution: DataFrame, path: str, by: str = "ho_type") -> None:
    """One folder per handover type."""
    distribution.write.partitionBy(by).parquet(path)


def adjacency_lines(edges: DataFrame) -> DataFrame:
    """Lines `bs n1 n2 …`, neighbours sorted: column `value`."""
    texts = F.transform("neighbors", lambda n: n.cast("string"))
    return neighbor_sets(edges).select(
        F.concat_ws(" ", F.col("bs").cast("string"), F.array_join(texts, " ")).alias("value")
    )


def write_adjacency(edges: DataFrame, path: str) -> None:
    """Neighbour lists as text; `read_neighbors` reads them back."""
    adjacency_lines(edges).write.text(path)


WIDE_COLUMNS = ("bs", "descr", "dist_km", "bearer", "ue")


def wide_trace(trace: DataFrame, k: int) -> DataFrame:
    """One row per time with columns `<column>_<rank>` of the `k` stations that vary most.

    Takes a `top_volatile_trace`, best as a computed table. The columns depend on `k` alone, not
    on which stations come out; ranks without a station are null. This suits a top-k
    report; the long form is the same table by rows.
    """
    order = [F.desc("sd"), F.desc("descr"), F.desc("bs"), F.desc("dist_km")]
    # At most k rows.
    ranks = trace.select("bs", "descr", "dist_km", "sd").distinct().select(
        F.col("bs").alias("_bs"), F.row_number().over(Window.orderBy(*order)).alias("rank")
    )
    placed = trace.join(F.broadcast(ranks), F.col("bs") == F.col("_bs"))
    return placed.groupBy("minutes").agg(
        *(F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}_{r}") for r in range(1, k + 1) for c in WIDE_COLUMNS)
    )


def write_record_files(lines: DataFrame, path: str, clock: str) -> None:
    """Lines (column `line`) as gzip files in one folder `clock=HH-MM` per text of column `clock`.

    `read_records` takes the time of a file from its folder where its name has none.
    """
    lines.select("line", F.col(clock).alias("clock")).write.partitionBy("clock").option(
        "compression", "gzip"
    ).text(path)


def write_by_station(records: DataFrame, path: str) -> None:
    """Records in one folder per station.

    Range partitioning on station and time cuts a busy station into several
    tasks and files.
    """
    (
        records.repartitionByRange("bs", "start_ms", "rec_seq")
        .write.partitionBy("bs")
        .parquet(path)
    )
