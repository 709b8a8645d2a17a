"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Edges up to which one task finds the components of the whole table; 16 bytes each, or two strings. More go by stars.
LOCAL_EDGES = 1 << 18


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component): the smallest node each node is linked to, over any number of steps.

    A written table of at most ``local_edges`` edges is read by one task. Otherwise each round links every node of a star to the star's smallest member, first towards larger, then towards smaller
    neighbours, so long chains shrink by half a round and no group is gathered: both steps are aggregations and joins on
    the node. Rounds are written to the shared folder, which cuts lineage. Loops and repeated edges change nothing, nulls
    are ignored, and nodes without an edge to another node do not appear.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null and a != b")
    # stars: each row points from a node to a smaller one
    e = materialise(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    if e.count() <= local_edges:
        kind = e.schema["u"].dataType.simpleString()
        return e.coalesce(1).mapInArrow(_small, f"node {kind}, component {kind}")
    state = _state(e)
    for _ in range(max_rounds):
        # large step: a node hands its smallest neighbour to its larger neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small step: a node hands its smallest neighbour to itself and its smaller neighbours
        large = large.filter("u != v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        nxt = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        nxt = materialise(nxt, "components")
        before, state, e = state, _state(nxt), nxt
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()


def _state(stars: DataFrame) -> tuple:
    """Number of rows and sums of two hashes of a written table; equal for equal sets of rows."""
    h, g = F.xxhash64("u", "v"), F.hash("v", "u")
    return tuple(stars.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(g.cast("bigint"))).first())


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of one task's edges: every node takes the smallest number that it or its neighbours' parents have."""
    edges = [b for b in batches if b.num_rows]
    if not edges:
        return
    kind = edges[0].schema.field(0).type
    ends = [np.concatenate([np.array(b.column(k).to_pylist(), object if pa.types.is_string(kind) else None) for b in edges]) for k in (0, 1)]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    u, v = at[: len(ends[0])], at[len(ends[0]) :]
    f = np.arange(len(nodes))
    while True:
        g = f[f]
        new = g.copy()
        np.minimum.at(new, f[u], g[v])
        np.minimum.at(new, f[v], g[u])
        np.minimum.at(new, u, g[v])
        np.minimum.at(new, v, g[u])
        if (new == f).all():
            break
        f = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes.tolist(), kind), pa.array(nodes[f].tolist(), kind)], names=["node", "component"])
