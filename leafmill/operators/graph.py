"""Connected groups of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import cut


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of all nodes that links (u, v, of one type) touch.

    Repeated least labels with pointer jumping. Every round is written to the shared folder; the driver
    sees one flag a round, never a link. Links with a null end are left out; without links there are no rows.
    """
    known = links.where("u is not null and v is not null").select("u", "v")
    edges = cut(known.union(known.select("v", "u")).distinct())
    label = cut(edges.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("component")))
    while True:
        around = edges.join(label.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("_near"))
        least = label.join(around, "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("_mid"))
        far = label.select(F.col("node").alias("_mid"), F.col("component").alias("_far"))
        step = cut(least.join(far, "_mid", "left").select("node", "_old", F.least("_mid", F.coalesce("_far", "_mid")).alias("component")))
        label = step.select("node", "component")
        if step.where("component <> _old").isEmpty():
            return label
