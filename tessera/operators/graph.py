"""Reachability over edges (src, dst), and segments of dotted or slashed hierarchies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import first_segment
from ..storage import forget, saved


def descendants(edges: DataFrame, roots: DataFrame, max_depth: int = 100) -> DataFrame:
    """(node, depth): every node reachable from roots (node), each once, with its least number of steps; roots aren't in it
    unless a cycle comes back to them, and then only if they aren't roots.

    One join per level; each level's new nodes are a table in the shared folder, which cuts lineage. A level is anti-joined
    with the tables of all before it. Raises if max_depth isn't enough.
    """
    e = saved(edges.select("src", "dst").distinct(), "edges")
    seen = roots.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, max_depth + 2):
        reached = frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        fresh = reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        fresh = saved(fresh, "level")
        if fresh.isEmpty():
            break
        if depth > max_depth:
            raise ValueError(f"more than {max_depth} levels")
        seen, frontier = seen.unionByName(fresh), fresh
    forget(e)
    return seen.where("depth > 0")


class Closure:
    """All (src, dst) where dst is reachable from src, kept up as edges come and go, so that asking is one filter.

    Added edges are joined semi-naively: only pairs that are new meet the known ones, on either side, so a chain of n steps
    takes about log2 n rounds. Removed edges first take away every pair that some walk through them may have made, then what
    of these the remaining edges still make comes back the same way. Work follows the pairs that change, not the table; a
    round is a few equi-joins and a stored table. Cycles are allowed: then nodes reach themselves.
    """

    def __init__(self, edges: DataFrame):
        none = edges.select("src", "dst").limit(0)
        self.edges, self.pairs = saved(none, "edges"), saved(none, "pairs")
        self.add(edges)

    def reachable(self, roots: DataFrame) -> DataFrame:
        """(node): what is reachable from any of roots (node), each once."""
        return self.pairs.join(roots.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("node")).distinct()

    def add(self, edges: DataFrame) -> None:
        new = saved(edges.select("src", "dst").where("src is not null and dst is not null").distinct().join(self.edges, ["src", "dst"], "left_anti"), "edges")
        self._keep(self.edges.unionByName(new), self._grown(self.pairs, new.join(self.pairs, ["src", "dst"], "left_anti")))
        forget(new)

    def remove(self, edges: DataFrame) -> None:
        gone = saved(edges.select("src", "dst").distinct().join(self.edges, ["src", "dst"], "left_semi"), "edges")
        left = saved(self.edges.join(gone, ["src", "dst"], "left_anti"), "edges")
        # Sources that reach a removed edge, and what is reached behind it; the edge's own ends included.
        before = gone.select(F.col("src").alias("via"), F.col("dst").alias("to")).join(self.pairs.select("src", F.col("dst").alias("via")), "via").select("src", "to")
        before = before.unionByName(gone.select("src", F.col("dst").alias("to"))).distinct()
        behind = before.join(self.pairs.select(F.col("src").alias("to"), "dst"), "to").select("src", "dst").unionByName(before.select("src", F.col("to").alias("dst")))
        doubt = saved(behind.distinct().join(self.pairs, ["src", "dst"], "left_semi"), "doubt")
        sure = saved(self.pairs.join(doubt, ["src", "dst"], "left_anti"), "pairs")
        # A pair in doubt holds if it is an edge, or an edge followed by a pair that holds.
        step = left.select("src", F.col("dst").alias("via")).join(sure.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
        seeds = left.unionByName(step).distinct().join(doubt, ["src", "dst"], "left_semi")
        self._keep(left, self._grown(sure, seeds))
        for t in (gone, doubt, sure):
            forget(t)

    def _grown(self, known: DataFrame, delta: DataFrame, rounds: int = 64) -> DataFrame:
        """known and delta closed under joining ends."""
        parts, delta = [known], saved(delta, "delta")
        for _ in range(rounds):
            if delta.isEmpty():
                return saved(reduce(DataFrame.unionByName, parts), "pairs")
            parts.append(delta)
            all_ = reduce(DataFrame.unionByName, parts)
            ahead = delta.select("src", F.col("dst").alias("via")).join(all_.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
            back = all_.select("src", F.col("dst").alias("via")).join(delta.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
            delta = saved(ahead.unionByName(back).distinct().join(all_, ["src", "dst"], "left_anti"), "delta")
        raise RuntimeError("pairs did not settle")

    def _keep(self, edges: DataFrame, pairs: DataFrame) -> None:
        old = self.edges, self.pairs
        self.edges, self.pairs = saved(edges, "edges"), pairs
        for t in old:
            forget(t)


def limited(reached: DataFrame, n: int = 50, keep: Column | None = None) -> DataFrame:
    """The first n reachable nodes by depth, then name, that pass keep; nodes that don't pass were still walked through."""
    return (reached if keep is None else reached.where(keep)).orderBy("depth", "node").limit(n)


def child_segments(keys: DataFrame, base: str, sep: str = ".", column: str = "key") -> DataFrame:
    """(segment): distinct next segments of keys below base."""
    start = f"{base}{sep}" if base else ""
    rest = F.substring(F.col(column), F.lit(len(start) + 1), F.length(column))
    seg = first_segment(rest) if sep == "." else F.substring_index(rest, sep, 1)
    return keys.where(F.col(column).startswith(start)).select(seg.alias("segment")).where("segment <> ''").distinct()


def names_in(entries: DataFrame, parent: str, start: str = "") -> DataFrame:
    """(name): distinct names directly in parent that begin with start, letter case aside. entries: parent, name."""
    return entries.where((F.col("parent") == parent) & F.lower("name").startswith(start.lower())).select("name").distinct()
