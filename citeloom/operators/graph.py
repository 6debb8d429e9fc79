"""Level-synchronous walks over a citation graph, and connected components; what is reached is a table and every level is checkpointed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import columns as C
from citeloom.operators.relational import group_positions
from citeloom.session import checkpointed

#: The levels found so far are put together whenever there are so many tables of them.
FOLD = 16


def adjacency(edges: DataFrame) -> DataFrame:
    """(cited_id, position, citing_id): the distinct citing papers of each cited one in order, in long form, as one may have any number."""
    e = edges.where("cited_id is not null and citing_id is not null").select("cited_id", "citing_id").distinct()
    return group_positions(e, "cited_id", ["citing_id"])


def expandable(nodes: DataFrame, more_than: int = 2) -> DataFrame:
    """Nodes whose citers are worth reading: cited often enough and with a readable id."""
    return nodes.where((F.col("cited") > more_than) & F.coalesce(C.is_number_text(F.col("urlid")), F.lit(False))).select("id")


def bfs_levels(edges: DataFrame, start: DataFrame, may_expand: DataFrame | None = None, seen_limit: float | None = None) -> DataFrame:
    """(id, level) of all nodes reached from the start; each once, at its lowest level.

    may_expand: only these nodes are expanded (the start always is). seen_limit: children of a node are recorded but not
    expanded if at least this share of them had been seen; within a level a child is new to the least of its parents.
    Equals first-in-first-out order up to ties.
    """
    links = checkpointed(edges.where("cited_id is not null and citing_id is not null").select("cited_id", "citing_id").distinct())
    levels = [checkpointed(start.select("id").distinct().withColumn("level", F.lit(0)))]
    frontier, level = levels[0].select("id"), 0
    while True:
        level += 1
        visited = reduce(DataFrame.unionByName, levels)
        if may_expand is not None and level > 1:
            frontier = frontier.join(may_expand, "id", "left_semi")
        reached = frontier.join(links, F.col("id") == F.col("cited_id")).select("cited_id", "citing_id")
        known = visited.select(F.col("id").alias("citing_id"), F.lit(1).alias("_old"))
        found = reached.join(known, "citing_id", "left")
        first = found.where("_old is null").groupBy("citing_id").agg(F.min("cited_id").alias("parent"))
        if seen_limit is None:
            new = first.select(F.col("citing_id").alias("id"), F.lit(True).alias("go"))
        else:
            per = reached.groupBy("cited_id").agg(F.count("*").alias("n")).join(first.groupBy(F.col("parent").alias("cited_id")).agg(F.count("*").alias("n_new")), "cited_id")
            fresh = per.where((F.col("n") - F.col("n_new")) / F.col("n") < seen_limit).select(F.col("cited_id").alias("parent"), F.lit(True).alias("go"))
            new = first.join(fresh, "parent", "left").select(F.col("citing_id").alias("id"), F.coalesce("go", F.lit(False)).alias("go"))
        new = checkpointed(new)
        if new.isEmpty():
            return visited
        # each level is written once, and read again as it is
        levels.append(new.select("id", F.lit(level).alias("level")))
        if len(levels) == FOLD:
            levels = [checkpointed(reduce(DataFrame.unionByName, levels))]
        frontier = new.where("go").select("id")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge to another: the root is the least node of its component.

    Alternates large and small stars, so the number of rounds grows with the logarithm of the longest chain and no node's
    neighbours are ever gathered in one row. NULL ends and loops are no edges; an empty table gives an empty result.
    """
    both = F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b")))
    # (larger, smaller) end of each edge
    tree = checkpointed(edges.where(F.col(a) != F.col(b)).select(F.explode(both).alias("e")).select("e.*").where("a > b").distinct())
    while True:
        # done where nodes have one smaller neighbour at most and those that have one are no one's smaller neighbour
        ends = tree.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(tree.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            return tree.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(tree.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        two = tree.unionByName(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = two.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = two.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        tree = checkpointed(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
