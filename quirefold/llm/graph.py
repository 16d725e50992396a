"""Connected components of links between long ids, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import stored

#: Labels of up to this many nodes (two longs each) are broadcast; above, joins shuffle.
MAX_LABELS = 200_000


def components(links: DataFrame) -> DataFrame:
    """(id, component) for links (a, b): the least id reachable.

    Every node points at a node that isn't greater. Each round, the label of a node's label goes
    over each of its links, both to the neighbour and to the node that the neighbour points at, so
    whole trees hook onto each other and the number of rounds grows with the logarithm of a
    chain's length. Minima combine before the shuffle, so a node with very many links costs no
    more than those links. A round without a change means that all nodes point at their least one.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    edges = stored(both.union(both.select("a", F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")), "labels")
    hint = F.broadcast if labels.count() <= MAX_LABELS else lambda x: x
    while True:
        second = labels.select(F.col("id").alias("component"), F.col("component").alias("low"))
        lows = labels.join(hint(second), "component").select(F.col("id").alias("b"), "low")
        own = labels.select(F.col("id").alias("a"), "component")
        told = edges.join(hint(lows), "b").join(hint(own), "a")
        old = F.when(F.col("a") == F.col("b"), F.col("component"))
        # The pair of a node with itself is among the edges: no node is lost, and each tells its old label.
        goes = F.explode(
            F.array(
                F.struct(F.col("a").alias("id"), "low", old.alias("old")),
                F.struct(F.col("component").alias("id"), "low", F.lit(None).cast("bigint").alias("old")),
            )
        )
        new = told.select(goes.alias("t")).select("t.*").groupBy("id").agg(F.min("low").alias("component"), F.max("old").alias("old"))
        new = stored(new, "labels")
        if new.filter("old <> component").limit(1).count() == 0:
            return new.select("id", "component")
        labels = new.select("id", "component")
