"""Every catalog query against its SQL."""

import os

import pytest
from compare import connect, difference

from pyspark.sql import functions as F

from cellpulse.catalog import QUERIES
from cellpulse.oracle import ORACLE

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    assert difference(QUERIES[name](spark, SF_DIR), connection, ORACLE[name]) is None


@pytest.fixture(scope="module")
def longer(spark, tmp_path_factory):
    """The events, and the same events sixty days later, past the grid of the bucketed queries."""
    folder = tmp_path_factory.mktemp("longer")
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    later = events.withColumns(
        {"event_id": F.col("event_id") + 10_000_000, "ts": F.expr("ts + INTERVAL '60' DAY")}
    )
    events.unionByName(later.select(events.columns)).coalesce(1).write.parquet(f"{folder}/all")
    (part,) = (folder / "all").glob("*.parquet")
    os.link(part, folder / "events.parquet")
    return str(folder)


@pytest.mark.parametrize(
    "name",
    "bs_from_cell failed_records handover_durations handover_cdf neighbor_sets ue_timeline proc_counts"
    " distinct_bs agg_load neighbor_flow stream_counts handover_load".split(),
)
def test_records_past_the_grid(spark, longer, name):
    result = QUERIES[name](spark, longer)
    assert difference(result, connect(longer), ORACLE[name]) is None
    if name == "bs_from_cell":
        assert result.count() == 2 * spark.read.parquet(f"{SF_DIR}/events.parquet").count()


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == [
        "bs", "descr", "dist_km", "sd", "minutes", "ue", "bearer",
    ]
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())
