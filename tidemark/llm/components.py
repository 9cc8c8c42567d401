"""Consolidating pairs into groups on a two-dimensional grid of blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, ship

#: Blocks of vertices there are at least; the grid has the square of it as cells.
LEAST_BLOCKS = 4

#: Edges that a task holds at a time; further ones form another local graph.
EDGES_AT_ONCE = 1_000_000


def local_roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest vertex of each vertex's component; vertices are 0 .. n-1.

    Union by smallest label on whole arrays: every edge pulls the roots of
    its ends to the smaller one, then paths are halved until all are flat.
    """
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            return root
        u, v = u[open_], v[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The edges of one grid cell as (vertex, smallest vertex it reaches)."""
    t = pa.Table.from_batches(batches)
    names = pa.chunked_array(t["u"].chunks + t["v"].chunks).combine_chunks()
    encoded = names.dictionary_encode()
    codes, words = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
    by_name = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(words), dtype=np.int64)
    rank[by_name] = np.arange(len(words))
    ranked = rank[codes]
    m = len(ranked) // 2
    root = local_roots(ranked[:m], ranked[m:], len(words))
    child = np.flatnonzero(root != np.arange(len(words)))
    return pa.record_batch([words.take(pa.array(by_name[child])), words.take(pa.array(by_name[root[child]]))], ["v", "r"])


def _union_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= EDGES_AT_ONCE:
            yield _stars(held)
            held, rows = [], 0
    if rows:
        yield _stars(held)


def components(
    pairs: DataFrame, left: str, right: str, *, cell_edges: int = 250_000, max_rounds: int = 60
) -> DataFrame:
    """``vertex, group``: each vertex of a pair with the smallest one it is linked to.

    A group has at least two vertices and is named by its smallest. Null ends
    and pairs of a vertex with itself are left out (so a vertex that only has
    those does not appear); order and repetition of pairs do not matter; an
    empty table gives an empty result. Vertices are compared as strings.

    Vertices are hashed into blocks and pairs lie in the grid cell of their
    two blocks. In each round every cell runs a local union-find over its
    pairs, which leaves each vertex with the representatives that the cells
    of its row and column found for it. They are exchanged: each of them is
    followed to its own smallest representative, and the smallest of those
    becomes the parent of the vertex and of all its representatives, which
    shortens every way at least by half. Rounds go on until the parents are
    stable, that is, until each vertex has one parent and no parent has one.

    Scale: a hot vertex has its pairs in one row and column of the grid, not
    in one task; a task works through its cells in bounded portions, since a
    local union-find may be run on any part of the pairs. The grid has at
    least :data:`LEAST_BLOCKS` rows and columns and grows with the pairs
    (``cell_edges`` a cell on average). Each round is a few shuffles
    of narrow rows and is checkpointed (AQE splits the join where one parent
    has a large share of all vertices); only counts reach the driver.
    """
    ship(pairs.sparkSession)
    edges = (
        pairs.select(F.col(left).cast("string").alias("u"), F.col(right).cast("string").alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )
    edges = cut_lineage(edges)
    grid = max(LEAST_BLOCKS, math.ceil(math.sqrt(edges.count() / cell_edges)))
    for _ in range(max_rounds):
        cells = edges.repartition(
            grid * grid, F.pmod(F.xxhash64("u"), F.lit(grid)), F.pmod(F.xxhash64("v"), F.lit(grid))
        )
        stars = cut_lineage(cells.mapInArrow(_union_cells, "v string, r string").distinct())
        parents = stars.groupBy("v").agg(F.min("r").alias("p"))
        above = parents.select(F.col("v").alias("_r"), F.col("p").alias("_gp"))
        # What the row and column of each vertex hold of it, at most one
        # representative for each cell and portion, and where those lead.
        met = (
            stars.join(above, F.col("r") == F.col("_r"), "left")
            .groupBy("v")
            .agg(F.min(F.coalesce("_gp", "r")).alias("_top"), F.collect_set("r").alias("_rs"))
        )
        links = (
            met.select(F.col("_top").alias("u"), F.explode(F.concat(F.array("v"), "_rs")).alias("v"))
            .where("u <> v")
            .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
            .distinct()
        )
        edges = cut_lineage(links)
        # Stable: all links go from a root (never a child) to a child of one parent.
        children = edges.groupBy("v").agg(F.count("*").alias("n"))
        unstable = children.where("n > 1").select("v").limit(1).union(
            edges.select(F.col("u").alias("v")).distinct().join(children.select("v"), "v", "left_semi").limit(1)
        )
        if unstable.isEmpty():
            break
    else:
        raise RuntimeError(f"the parents were not stable after {max_rounds} rounds")
    return edges.select(F.col("v").alias("vertex"), F.col("u").alias("group")).unionByName(
        edges.select(F.col("u").alias("vertex"), F.col("u").alias("group")).distinct()
    )
