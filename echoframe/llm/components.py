"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, written


def components(links: DataFrame) -> DataFrame:
    """(v, comp) of all vertices of links (a, b); comp is the smallest vertex reachable.

    Each round a vertex takes the smallest label among its neighbours and then
    its label's label, so chains halve; the driver sees only one count a round.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).toDF("v", "w").filter("v != w").distinct(), "links")
    labels = written(both.groupBy("v").agg(F.least("v", F.min("w")).alias("comp")), "labels")
    while True:
        near = both.join(labels.toDF("w", "near"), "w").groupBy("v").agg(F.min("near").alias("near"))
        step = labels.join(near, "v").select("v", F.least("comp", "near").alias("next"), "comp")
        jump = step.join(labels.toDF("next", "far"), "next", "left").select("v", F.least("next", F.coalesce("far", "next")).alias("next"), "comp")
        new = written(jump.select("v", F.col("next").alias("comp"), (F.col("next") != F.col("comp")).alias("moved")), "labels")
        moved = new.filter("moved").limit(1).count()
        forget(labels)
        kept = new.select("v", "comp")
        kept._written_path = new._written_path
        labels = kept
        if not moved:
            forget(both)
            return labels
