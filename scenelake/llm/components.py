"""Connected components of a link table, by minimum labels with pointer jumping.

Every round joins links to labels, takes the smallest label around each node and follows one
pointer, so that labels travel twice as far each time.  Rounds are written to the shared folder,
which cuts the lineage; only one count per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import drop_staged, staged


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node that has a link.

    ``links`` has long columns ``u`` and ``v``; direction, repeats and self links don't matter,
    links with a null end are ignored, and no links give no rows.
    """
    ends = links.where("u <> v")
    ends = ends.union(ends.select(F.col("v"), F.col("u"))).toDF("u", "v")
    ends = staged(ends.distinct(), "links")
    labels = staged(
        ends.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")),
        "labels",
    )
    while True:
        of_end = labels.select(F.col("node").alias("v"), F.col("label").alias("l"))
        around = ends.join(of_end, "v").groupBy(F.col("u").alias("node")).agg(F.min("l").alias("m"))
        jump = labels.select(F.col("node").alias("t"), F.col("label").alias("tl"))
        after = (
            labels.join(around, "node")
            .select("node", F.col("label").alias("was"), F.least("label", "m").alias("t"))
            .join(jump, "t")
            .select("node", "was", F.least("t", "tl").alias("label"))
        )
        new = staged(after, "labels")
        changed = new.where("label <> was").limit(1).count()
        drop_staged(labels)
        labels = new.select("node", "label")
        if not changed:
            return labels
