"""Connected components of links between integer labels, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfpace.llm.staging import stage


def contract(links: DataFrame) -> DataFrame:
    """(label, root) for every label in ``links`` (a, b): root is the smallest label it is linked with, over any number of steps.

    Each round hooks every label to its smallest neighbour, shortens these paths by doubling, and goes on with the links
    between different roots. The number of rounds grows with the logarithm of the number of labels; all tables stay in Spark.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    links = stage(links, "links")
    roots = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stage(both.groupBy(F.col("a").alias("label")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "hooks")
        while True:
            above = up.select(F.col("label").alias("root"), F.col("root").alias("next"))
            up = stage(up.join(above, "root", "left").select("label", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") < F.col("root")).alias("moved")), "hooks")
            if up.filter("moved").isEmpty():
                break
            up = up.drop("moved")
        up = up.select("label", "root")
        a, b = up.toDF("a", "ra"), up.toDF("b", "rb")
        links = stage(links.join(a, "a").join(b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        if roots is None:
            roots = up
        else:
            later = up.select(F.col("label").alias("root"), F.col("root").alias("next"))
            roots = stage(roots.join(later, "root", "left").select("label", F.coalesce("next", "root").alias("root")), "roots")
    return roots if roots is not None else links.select(F.col("a").alias("label"), F.col("b").alias("root"))
