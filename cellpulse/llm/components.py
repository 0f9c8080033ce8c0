"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import landed


def components(links: DataFrame) -> DataFrame:
    """`node, component` for each node of `links` (`a, b`); the component is its least node.

    Every round sends each node the least label among its neighbours and then the
    label of its label, so labels travel twice as far each time. Rounds end when nothing
    changes. Minima are aggregated before they are shuffled, so a node with very many links
    is one row per task. Each round's labels are a table in the shared folder.
    """
    both = landed(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "component-links",
    )
    labels = landed(
        both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.col("node"), F.min("b")).alias("component")
        ),
        "component-labels",
    )
    while True:
        heard = (
            both.join(labels, both.b == labels.node)
            .groupBy("a")
            .agg(F.min("component").alias("heard"))
        )
        lower = labels.join(heard, labels.node == heard.a).select(
            "node", F.col("component").alias("was"), F.least("component", "heard").alias("component")
        )
        further = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = landed(
            lower.join(further, "component").select(
                "node", "was", F.least("component", "next").alias("component")
            ),
            "component-labels",
        )
        labels = jumped.select("node", "component")
        if jumped.where(F.col("component") != F.col("was")).isEmpty():
            return labels
