"""Distributed connected components by alternating stars, and a way to stream sorted groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import discard, release_memory, settle


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b).

    Large-star and small-star rounds (each a grouped minimum, which combines before the shuffle, and
    an equi-join) until the edges stay as they are; their number falls with the logarithm of the
    longest path. Each round is written to the shared folder, so lineage stays short, and the round
    before it is deleted."""
    e = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        nxt = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, e = e, settle(nxt.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(before)
        r = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (r["n"], r["x"]) == mark:
            break
        mark = (r["n"], r["x"])
    roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def sorted_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str, n: int | None = None, together: bool = False) -> DataFrame:
    """fn of each group of equal keys, streamed from sorted partitions: a task holds one group and one
    batch, and small groups cost no more than a slice. Callers bound the size of their groups. With
    together, fn gets all groups that end in a batch at once."""
    df = df.repartition(n, *keys) if n else df.repartition(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            ks = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(b.num_rows, bool)
            for k in ks:
                change[1:] |= k[1:] != k[:-1]
            change[0] = last is not None and any(k[0] != x for k, x in zip(ks, last))
            last = [k[-1] for k in ks]
            cuts = [*np.flatnonzero(change).tolist(), b.num_rows]
            if together and len(cuts) > 2:
                cuts = cuts[-2:]
            at = 0
            for c in cuts[:-1]:
                held.append(b.slice(at, c - at))
                out = fn(pa.Table.from_batches(held))
                held, at = [], c
                if out is not None and out.num_rows:
                    yield out
            held.append(b.slice(at))
        if held:
            out = fn(pa.Table.from_batches(held))
            if out is not None and out.num_rows:
                yield out
        held = []
        release_memory()

    return df.sortWithinPartitions(*keys).mapInArrow(run, schema)


def labels_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least index that each of n reaches by links a[i] - b[i]."""
    labels = np.arange(n)
    while True:
        nxt = labels.copy()
        np.minimum.at(nxt, a, labels[b])
        np.minimum.at(nxt, b, labels[a])
        nxt = nxt[nxt]
        if (nxt == labels).all():
            return labels
        labels = nxt
