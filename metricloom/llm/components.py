"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.sources.scratch import dropped, written


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; component is its least node.

    Alternating star contraction: each round hangs a node's larger neighbours on
    its least neighbour, then its smaller ones, until nothing changes. A round is
    two aggregations and joins with one row per link, and is written to the
    shared folder in place of the last, so lineage stays short and no node's links
    are ever gathered.
    Links with a null end are ignored.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both, F.col("v") > F.col("u"))
        before_round, edges = edges, written(_hang(large, F.lit(True), keep=True))
        dropped(before_round)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _hang(edges: DataFrame, which, keep: bool = False) -> DataFrame:
    """Links from each end ``v`` chosen by ``which``, and with ``keep`` from ``u``, to u's least neighbour."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = edges.where(which).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if keep:
        hung = hung.unionByName(least.select("u", F.col("m").alias("v")))
    # v of a link is its smaller end; a link to itself says nothing.
    return hung.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
