"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: Links up to this many, counted first, are joined up within one task; 16 bytes each.
ONE_TASK = 2_000_000


def join_up(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for links u-v, by hooking roots and halving paths."""
    nodes, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return nodes, nodes[root]


def components(links: DataFrame, scratch: Scratch, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): the smallest node reachable from each node of links(a, b).

    Few links are joined up in one task. More of them go the distributed way, which
    alternates large-star and small-star steps, in which every node hands its
    neighbours to its smallest one, until nothing changes; the number of rounds
    grows with the logarithm of the longest chain. A node with very many
    neighbours only has a minimum taken over them, which is combined before the
    shuffle, and its join is split by adaptive execution.
    """
    edges = scratch.save(
        links.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    )
    if edges.count() <= one_task:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
            if got:
                node, name = join_up(*(np.concatenate(x) for x in zip(*got, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(name)], names=["node", "component"])

        return scratch.save(edges.coalesce(1).mapInArrow(run, "node long, component long"))
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("m").alias("u"), "v").distinct()
        # now u < v in every row: small-star looks from v at its smaller neighbours
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(low, "v")
            .select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        new = scratch.save(small)
        now = tuple(
            new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        )
        scratch.drop(edges)
        edges = new
        if now == state or now[0] == 0:
            own = edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
            return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(own)
        state = now
