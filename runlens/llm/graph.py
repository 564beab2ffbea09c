"""Connected components of links, by contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import common


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: one row per linked node; nodes reach each other exactly if they have the same root (itself a node).

    Each round every node joins the neighbour (or itself) that a hash of the round ranks lowest, and links are renamed and
    reduced to those between different groups. Ranks are random, so a constant share of the nodes goes in each round, also
    of long chains, and a hub is one group after its round. Minima are combined before the shuffle; what a round leaves is
    written to the shared folder. Links with a null end are ignored; repeated links and links to itself are allowed.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    edges = common.saved(pairs.distinct(), "links")
    maps, turn = [], 0
    while True:
        both = edges.union(edges.select("b", "a"))
        rank = F.xxhash64(F.lit(turn), F.col("b"))
        own = F.xxhash64(F.lit(turn), F.col("a"))
        best = both.groupBy("a").agg(F.min(F.struct(rank.alias("r"), F.col("b").alias("v"))).alias("m"))
        best = best.select(F.col("a").alias("node"), F.when(F.struct(own, "a") <= F.struct("m.r", "m.v"), F.col("a")).otherwise(F.col("m.v")).alias("root"))
        best = common.saved(best, f"round{turn}")
        maps.append(best)
        renamed = edges.join(best, F.col("a") == F.col("node")).select(F.col("root").alias("x"), "b")
        renamed = renamed.join(best, F.col("b") == F.col("node")).select("x", F.col("root").alias("y")).where("x <> y")
        edges = common.saved(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"links{turn}")
        turn += 1
        if edges.isEmpty():
            break
    out = maps[0]
    for step in maps[1:]:
        step = step.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        out = out.join(step, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as the links a-b do, at most one per node: each node and the first of its group."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (nearer := label[label]).tobytes() != label.tobytes():
            label = nearer
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]
