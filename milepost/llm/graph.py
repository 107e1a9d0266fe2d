"""Connected components of a link table, by contraction; nothing reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milepost.llm.text import stored


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is some node of its group.

    Each round points every node to its smallest neighbour if that is smaller,
    follows that pointer once more, and replaces the nodes of the links by what they
    point to. Every node with a smaller neighbour disappears, so the number of
    rounds is logarithmic. No link gives no row.
    """
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = stored(
        links.select("a", "b").union(turned).where("a <> b").distinct(), "links"
    )
    found = both.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    while not both.isEmpty():
        up = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        up = stored(up, "parents")
        next_up = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
        up = up.join(next_up, "p").select("a", F.col("q").alias("p"))
        up = stored(up, "parents")
        found = stored(
            found.join(up.withColumnRenamed("a", "root"), "root", "left")
            .select("node", F.coalesce("p", "root").alias("root")),
            "roots",
        )
        left = both.join(up, "a").select(F.col("p").alias("x"), "b")
        right = up.withColumnRenamed("a", "b")
        both = stored(
            left.join(right, "b").select(F.col("x").alias("a"), F.col("p").alias("b"))
            .where("a <> b").distinct(),
            "links",
        )
    return found
