"""Connected components of a graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Work

JUMPS = 2


def components(links: DataFrame, work: Work, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is its smallest node.

    Each round every node points to the smallest of itself and its neighbours, pointers are followed
    a few steps, and the links move to where they point; links within a point vanish. Nodes that
    many links meet in are combined per task before they travel. Rounds are written, so none is
    repeated when an executor is lost.
    """
    links = links.where("a <> b").select("a", "b")
    label, level = None, 0
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("node"), F.least("a", "low").alias("to"),
        )
        for _ in range(JUMPS):
            on = point.select(F.col("node").alias("via"), F.col("to").alias("further"))
            point = point.join(on, F.col("to") == F.col("via")).select("node", F.col("further").alias("to"))
        point = work.write(point, f"{name}-point{level}")
        if label is None:
            label = point.select("node", F.col("to").alias("component"))
        else:
            label = label.join(point.withColumnRenamed("node", "component"), "component", "left").select(
                "node", F.coalesce("to", "component").alias("component"),
            )
            label = work.write(label, f"{name}-label{level}")
        a = point.select(F.col("node").alias("a"), F.col("to").alias("at"))
        b = point.select(F.col("node").alias("b"), F.col("to").alias("bt"))
        links = links.join(a, "a").join(b, "b").where("at <> bt").select(
            F.least("at", "bt").alias("a"), F.greatest("at", "bt").alias("b"),
        ).distinct()
        links = work.write(links, f"{name}-links{level}")
        if links.isEmpty():
            return label
        level += 1
