"""Connected components of an undirected graph, by contraction in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """Columns node, label from edges (a, b): the label is the same just within a component.

    Every node points to the smallest of itself and its neighbours; pointers are followed to their
    ends; edges are drawn between the ends. The edges left shrink until none are; each step is
    written, so lineage stays short.
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "points")
        while True:  # pointers halve their length each time
            to = points.toDF("label", "next")
            moved = written(points.join(to, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("changed")), "points")
            discard(points)
            points = moved.select("node", "label")
            if moved.where("changed").isEmpty():
                break
        if labels is None:
            labels = points
        else:
            to = points.toDF("label", "next")
            longer = written(labels.join(to, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
            discard(labels)
            labels = longer
        a, b = points.toDF("a", "x"), points.toDF("b", "y")
        left = written(edges.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "edges")
        discard(edges)
        if points is not labels:
            discard(points)
        edges = left
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
