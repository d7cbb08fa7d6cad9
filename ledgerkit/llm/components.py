"""Connected components of a link table by alternating large-star and small-star steps.

Every step groups links by a node (a minimum, combined map-side) and joins it back;
nothing but a link count and a checksum reaches the driver. Each step's links are
written to the shared folder, which cuts the lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: every node's greater neighbours go to the least of its neighbours and
    itself. Small: its smaller neighbours and itself do."""
    if large:
        near = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = near.join(least, "a")
    if large:
        return moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = least.select("a", F.col("m").alias("b"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(own).where("a <> b").distinct()


def connected(links: DataFrame, name: str = "llm-links") -> DataFrame:
    """``links`` (columns ``a, b`` of any one ordered type) -> ``node, root``: the least
    node of its component, for every node that has a link to another node."""
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    state = None
    while True:
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == state:
            break
        state = (now["n"], now["s"])
        links = materialize(_star(_star(links, large=True), large=False), name)
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
