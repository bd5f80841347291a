"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, put, saved


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long; ids must be hashes). Returns (id, root) of every id that occurs; root is the least id of its
    component. Null ids link nothing; repeated links and loops count once; no links give no rows.

    Each round every vertex points to its least neighbour's least neighbour, links are redrawn between what they point to, and
    links inside a class vanish. As ids are hashes, their order is random along any path, so the number of
    vertices falls by a constant factor a round on average (ids in ascending order along a path would fall by two a round).
    Tables are written to the shared folder between rounds, so lineage stays short. The links' number, not that of all
    documents, sets the cost.
    """
    spark = links.sparkSession
    tidy = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, at = put(tidy(links), "links")
    roots, roots_at = None, None
    while roots is None or not edges.isEmpty():
        ends = edges.union(edges.select("b", "a"))
        low, low_at = put(ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).withColumnRenamed("a", "v"), "lows")
        # v -> to may be a chain; one jump halves it, the next round does the rest
        jump = low.alias("x").join(low.alias("y"), F.col("x.to") == F.col("y.v"), "left").select(F.col("x.v").alias("v"), F.coalesce(F.least("x.to", "y.to"), "x.to").alias("to"))
        jump, jump_at = put(jump, "jumps")
        drawn = edges.join(jump, edges["a"] == jump["v"]).select(F.col("to").alias("a"), "b")
        drawn = drawn.join(jump, drawn["b"] == jump["v"]).select("a", F.col("to").alias("b"))
        new_edges, new_at = put(tidy(drawn), "links")
        drop_saved(spark, at, low_at)
        edges, at = new_edges, new_at
        if roots is None:
            roots, roots_at = jump.select(F.col("v").alias("id"), F.col("to").alias("root")), jump_at
            continue
        new_roots, new_roots_at = put(roots.join(jump, roots["root"] == jump["v"], "left").select("id", F.coalesce("to", "root").alias("root")), "roots")
        drop_saved(spark, jump_at, roots_at)
        roots, roots_at = new_roots, new_roots_at
    drop_saved(spark, at)
    return roots


def moved(roots: DataFrame, later: DataFrame) -> DataFrame:
    """(id, root) after the roots themselves, or ids without links so far, were joined to ``later`` ones."""
    to = later.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
    out = roots.join(to, roots["root"] == to["_id"], "left").select("id", F.coalesce("_root", "root").alias("root"))
    fresh = later.join(roots.select("id"), "id", "left_anti")
    return saved(out.unionByName(fresh), "roots")
