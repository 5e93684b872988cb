"""Connected components of an edge table, by rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) for every vertex of ``edges(a, b)``: comp is the smallest vertex reachable.

    A round takes the least label among neighbours and then the label of that label, so that long chains halve. Rounds end
    when no label changes; each round's labels are a written table. No edges give no rows; edges with a null are ignored.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("comp").alias("near"))
        least = labels.join(near, labels["v"] == near["a"]).select("v", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        of = labels.select(F.col("v").alias("comp"), F.col("comp").alias("next"))
        stepped = written(least.join(of, "comp", "left").select("v", "old", F.coalesce(F.least("comp", "next"), "comp").alias("comp")), "labels")
        labels = stepped.select("v", "comp")
        if not stepped.where("old <> comp").limit(1).count():
            return labels
