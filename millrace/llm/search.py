"""Candidate search below shared nodes: which representatives of index nodes (trie prefixes, table buckets) belong together.

Nodes whose representatives are connected already are passed over. The others' rows are dealt to blocks of about BLOCK rows
by hash and compared there; of a node with several blocks, the representatives outside its largest component then meet all
of its rows, in pairs of blocks. Only spanning forests come back, never pairs. Hot nodes go by hub_join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, hub_join
from .lineage import drop, stage

BLOCK, LOT_ROWS = 2048, 20_000
EDGES = "a long, b long, band int, n long"


@dataclass(frozen=True)
class Search:
    leaves: Callable[[DataFrame], DataFrame]  # rows (rep, group) to (rep, group, tree, node)
    trees: int  # leaves of a representative
    payload: tuple[str, ...]  # what is compared
    below: Callable[[pd.DataFrame], pd.DataFrame]  # edges among rows of equal tree, node and block
    across: Callable[[pd.DataFrame], pd.DataFrame]  # edges from side 0 to side 1


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n points reaches over the edges (a, b)."""
    out = np.arange(n)
    while len(a):
        low = np.minimum(out[a], out[b])
        before = out.copy()
        np.minimum.at(out, out[a], low)
        np.minimum.at(out, out[b], low)
        out = out[out]
        if (out == before).all():
            break
        apart = out[a] != out[b]
        a, b = a[apart], b[apart]
    while (out[out] != out).any():
        out = out[out]
    return out


def spanning(rep: np.ndarray, a: np.ndarray, b: np.ndarray, seen: np.ndarray | None = None) -> pd.DataFrame:
    """Rows of EDGES: a spanning forest of the edges between rows a and b; rows without a and b count pairs by band."""
    ids, point = np.unique(rep, return_inverse=True)
    top = labels(len(ids), point[a], point[b])
    out = np.flatnonzero(top != np.arange(len(ids)))
    bands = np.flatnonzero(seen) if seen is not None else np.zeros(0, np.int64)
    none = [None] * len(bands)
    return pd.concat(
        [
            pd.DataFrame({"a": pd.array(ids[out], "Int64"), "b": pd.array(ids[top[out]], "Int64"), "band": 0, "n": 0}),
            pd.DataFrame({"a": pd.array(none, "Int64"), "b": pd.array(none, "Int64"), "band": bands, "n": seen[bands] if seen is not None else bands}),
        ]
    )


def _nodes(reps: DataFrame, groups: DataFrame | None, search: Search) -> tuple[DataFrame, DataFrame]:
    """Leaves with `group` (the component found so far), and nodes (staged) that are not yet connected, with their rows n."""
    if groups is None:
        own = reps.withColumn("group", F.col("rep"))
    else:
        own = reps.join(groups, reps["rep"] == groups["vertex"], "left").withColumn("group", F.coalesce("component", "rep")).drop("vertex", "component")
    leaves = search.leaves(own)
    nodes = leaves.groupBy("tree", "node").agg(F.count("*").alias("n"), F.min("group").alias("lo"), F.max("group").alias("hi"))
    return leaves, stage(nodes.where("lo < hi").select("tree", "node", "n"), "nodes", tidy=False)


def _within(reps: DataFrame, groups: DataFrame | None, search: Search, total: int) -> DataFrame:
    """Staged edges found within blocks of nodes."""
    leaves, nodes = _nodes(reps, groups, search)
    rows = nodes.agg(F.sum("n")).first()[0] or 0
    light = hub_join(leaves, nodes, ["tree", "node"], "n", search.trees * total)
    block = F.pmod(F.xxhash64("rep", "tree"), F.ceil(F.col("n") / BLOCK))
    lot = F.pmod(F.xxhash64("tree", "node", "block"), F.lit(max(1, rows // LOT_ROWS)))
    work = light.withColumn("block", block).join(reps.select("rep", *search.payload), "rep")
    work = work.select(lot.alias("lot"), "tree", "node", "block", "rep", "group", *search.payload)
    out = stage(work.groupBy("lot").applyInPandas(search.below, EDGES), "edges")
    drop(nodes)
    return out


def _between(reps: DataFrame, groups: DataFrame, search: Search, total: int) -> DataFrame | None:
    """Staged edges between the blocks of large nodes; None where no large node is left in several components."""
    leaves, nodes = _nodes(reps, groups, search)
    large = nodes.where(F.col("n") > BLOCK)
    if large.isEmpty():
        drop(nodes)
        return None
    light = stage(hub_join(leaves, large, ["tree", "node"], "n", search.trees * total), "leaves", tidy=False)
    parts = light.groupBy("tree", "node", "group").agg(F.count("*").alias("c"))
    most = parts.groupBy("tree", "node").agg(F.max_by("group", F.struct("c", "group")).alias("most"), F.sum("c").alias("m"), F.max("c").alias("c"))
    most = most.select("tree", "node", "most", "m", F.ceil((F.col("m") - F.col("c")) / BLOCK).cast("int").alias("left"))
    rows = hub_join(light.drop("n"), most, ["tree", "node"], "m", search.trees * total)
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    i, j = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("left")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(2)), blocks).cast("int")
    base = ["tree", "node", "rep", "group"]
    mine = rows.where("group != most").select(*base, i.alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"), F.lit(0).alias("side"))
    rest = rows.select(*base, F.explode(F.sequence(F.lit(0), F.col("left") - 1)).alias("i"), j.alias("j"), F.lit(1).alias("side"))
    work = mine.unionByName(rest).join(reps.select("rep", *search.payload), "rep")
    out = stage(work.groupBy("tree", "node", "i", "j").applyInPandas(search.across, EDGES), "edges")
    drop(nodes, light)
    return out


def connected(reps: DataFrame, groups: DataFrame | None, search: Search, total: int) -> tuple[DataFrame, dict[int, int]]:
    """(vertex, component), staged, of `total` representatives (rep and payload) after a search that goes on from `groups`
    (dropped), and how many pairs were seen by band."""
    bands: dict[int, int] = {}

    def joined(found: DataFrame, before: DataFrame | None) -> DataFrame:
        edges = found.where("a is not null").select("a", "b")
        if before is not None:
            edges = edges.unionByName(before.select(F.col("vertex").alias("a"), F.col("component").alias("b")))
        after = components(edges)
        for r in found.where("a is null").groupBy("band").agg(F.sum("n").alias("n")).collect():  # one row a band
            bands[r["band"]] = bands.get(r["band"], 0) + r["n"]
        drop(found, *([before] if before is not None else []))
        return after

    groups = joined(_within(reps, groups, search, total), groups)
    more = _between(reps, groups, search, total)
    return (groups if more is None else joined(more, groups)), bands


def block_pairs(members: DataFrame, share: Column) -> DataFrame:
    """A row for each pair of blocks that a member (component, rep, ...; staged) takes part in: i, j and side (0: in block
    i; the side of i = j is 0). A component has as many blocks as the aggregate `share` says, rounded up, dealt by hash."""
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.ceil(share).cast("int").alias("blocks"))
    placed = hub_join(members, sizes, ["component"], "n", members.count())
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = F.expr("transform(sequence(0, blocks - 1), x -> named_struct('i', least(x, block), 'j', greatest(x, block), 'side', if(x < block, 1, 0)))")
    own = [c for c in members.columns]
    return placed.select(*own, F.explode(pairs).alias("p")).select(*own, "p.i", "p.j", "p.side")
