"""Connected components of a link table, by rounds of large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of one orderable type -> (node, root): every node that has a link, with the least node it reaches.

    Each round keeps at most one row a link, groups are only ever reduced to their least member, and every round is
    written to the shared folder.  Null ends and links of a node to itself are left out.
    """
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a node go to the least around it
        large = written(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct(), "links")
        # small star: a node and its neighbours below go to the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = written(small.select("m", F.explode(F.array("a", "b")).alias("b")).where("m <> b").select(F.col("m").alias("a"), "b").distinct(), "links")
        changed = small.exceptAll(links).limit(1).count() or links.exceptAll(small).limit(1).count()
        links = small
        if not changed:
            break
    out = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return out.unionByName(out.select(F.col("root").alias("node"), "root").distinct())
