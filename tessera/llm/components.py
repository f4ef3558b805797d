"""Connected components of a link table by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: The stars shrink any graph within O(log^2 n) rounds; this stops a run that never settles.
MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of links (a, b) the smallest node that it reaches.

    links: two columns of one ordered type, either direction, repeats and loops allowed
    (loops and rows with nulls say nothing and are dropped). Nodes without links don't appear. Each
    round is two joins on the smaller node; both sides of each are written tables, so that adaptive
    execution may split the rows of a node that has very many links; no list of neighbours is ever built.
    Links of past rounds are deleted.
    """
    a, b = (F.col(f"`{c}`") for c in links.columns[:2])
    start = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    scratch = Scratch(links.sparkSession)
    now, path = scratch.write(start)
    for _ in range(MOST_ROUNDS):
        both = now.union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least, used = scratch.write(both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m")).select(F.col("hi").alias("u"), "m"))
        # Large star: neighbours above u go to u's smallest.
        large, used2 = scratch.write(now.join(least, F.col("lo") == F.col("u")).select("hi", F.col("m").alias("lo")).distinct())
        # Small star: neighbours below u, and u, go to u's smallest.
        low, used3 = scratch.write(large.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("u"), "m"))
        below = large.join(low, F.col("hi") == F.col("u"))
        small = below.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select(F.col("u"), F.col("m"))).where("hi <> lo").distinct()
        after, new = scratch.write(small)
        # Done when every link goes to a root: no node is both a child and a parent, and no child has two parents.
        odd = after.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1").select("hi").union(after.join(after.select(F.col("lo").alias("p")).distinct(), F.col("hi") == F.col("p"), "left_semi").select("hi"))
        for done in (path, used, used2, used3):
            scratch.drop(done)
        now, path = after, new
        if odd.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo"), F.col("lo")).distinct())
