"""Connected components of an edge table, without gathering edges or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.staging import keep


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``edges (a, b)``; the root is the component's smallest node.

    Each round points every node to its smallest neighbour, follows the pointers to
    their ends by doubling, and joins the ends of the edges that are left.  Stars and
    chains alike end in one round; nested ones need a number of rounds that grows with
    the logarithm of the component.  An edge of a node with itself gives that node alone.
    """
    left = keep(edges.select("a", "b").distinct(), "edges")
    found = None
    while True:
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        parent = ends.groupBy("node").agg(F.min("other").alias("low")).select(
            "node", F.least("node", "low").alias("root")
        )
        parent, moved = keep(parent, "parents"), True
        while moved:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            parent = keep(
                parent.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")),
                "parents",
            )
            moved = bool(parent.filter("moved").limit(1).count())
            parent = parent.drop("moved")
        if found is None:
            found = parent
        else:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            found = found.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
        a = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = keep(
            left.join(a, "a").join(b, "b").filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges",
        )
        if not left.limit(1).count():
            return found
