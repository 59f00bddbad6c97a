"""Near-duplicate embeddings: random-hyperplane hashing in several tables, exact cosines, components.

Equal vectors are one class first, so a vector that occurs in a third of the rows is compared once.
Each class gets one key a table (the signs of its products with ``bits`` random planes). Within a
bucket all pairs are compared in double precision by matrix products; a bucket of more than BLOCK
vectors becomes pairs of blocks, each a task's work of bounded size, and no pair is left out. A pair
that meets in several tables is counted in the first alone, from the keys that both carry, so counts
are exact without writing pairs down; of the links a block emits at most one edge a vector.

``tables`` follows from ``bits`` and the recall wanted of a pair at the threshold itself: a pair
at angle a agrees in a table with probability (1 - a / pi) ** bits. ``bits`` grows with the number
of classes, to keep buckets near BLOCK.

Vectors that are null, zero, or hold null or non-finite components link with nothing and are
components of their own, as are vectors of another length than any near one. Repeated rows are
vectors of their own and link. A null vec_id never is a component's id unless all ids are null; ids are read
as longs. Vectors travel in the precision that they have; their products are made in double precision."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import discard, settle, tune
from pagequarry.llm.components import connected_components, labels_of, sorted_groups

BLOCK = 1024
RECALL = 0.998


def parameters(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = max(6, round(math.log2(max(n, 2) / BLOCK)))
    agree = (1 - math.acos(min(threshold, 1.0)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree))) if agree < 1 else 1


def e_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.elementType.simpleString()


def near_duplicates(df: DataFrame, threshold: float = 0.9, column: str = "embedding", recall: float = RECALL, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of df."""
    spark = df.sparkSession
    tune(spark)
    e = F.col(column)
    ok = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v"), F.coalesce(ok, F.lit(False)).alias("ok"))
    keyed = rows.select("vec_id", "ok", "v", F.xxhash64("v").alias("cls"))
    classes = settle(keyed.where("ok").groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.any_value("v").alias("v")), "vec-classes")
    bits, tables = parameters(classes.count(), threshold, recall)
    single = e_type(df, column) == "float"
    kind = np.float32 if single else np.float64

    def unit(x: np.ndarray) -> np.ndarray:
        """Rows of length 1, in double precision."""
        x = x.astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x**2).sum(axis=1, keepdims=True))

    def hash_keys(batches):
        for b in batches:
            v = b.column("v")
            dims = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind)
            at = np.concatenate([[0], np.cumsum(dims)])
            signs = np.zeros((b.num_rows, tables), np.int32)
            packed: list[bytes] = [b""] * b.num_rows
            for d in np.unique(dims):
                of = np.flatnonzero(dims == d)
                x = flat[at[of][:, None] + np.arange(d)]
                planes = np.random.default_rng([seed, int(d)]).normal(size=(d, tables * bits))
                over = (unit(x) @ planes > 0).reshape(len(of), tables, bits)
                signs[of] = (over * (1 << np.arange(bits))).sum(axis=2)
                for i, row in zip(of, x):
                    packed[i] = row.tobytes()
            keys = signs.astype(np.int64) + (dims.astype(np.int64) << bits)[:, None]
            yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("n"), pa.array(packed, pa.binary()), pa.array([k.tobytes() for k in signs], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], ["cls", "n", "x", "sig", "keys"])

    hashed = settle(classes.select("cls", "n", "v").mapInArrow(hash_keys, "cls long, n long, x binary, sig binary, keys array<long>"), "vec-keys")
    entries = hashed.select("cls", "n", F.posexplode("keys").alias("t", "key"))
    sizes = entries.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    met = hashed.select("cls", "n", "x", "sig", F.posexplode("keys").alias("t", "key")).join(sizes.select("t", "key", "blocks"), ["t", "key"])
    met = met.withColumn("block", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int"))
    # every pair of blocks i <= j meets once: a vector goes to (block, j) and (i, block)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("t", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "n", "x", "sig")

    def compare(g: pa.Table) -> pa.RecordBatch | None:
        i, j, t = g.column("i")[0].as_py(), g.column("j")[0].as_py(), g.column("t")[0].as_py()
        g = g.combine_chunks()
        block = g.column("block").to_numpy()
        cls, n = g.column("cls").to_numpy(), g.column("n").to_numpy()
        if len(cls) < 2:
            return None
        x = unit(np.stack([np.frombuffer(b, kind) for b in g.column("x").to_pylist()]))
        left, right = (np.arange(len(cls)),) * 2 if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))
        a, b = np.nonzero(x[left] @ x[right].T >= threshold)
        a, b = left[a], right[b]
        once = a < b if i == j else a != b
        a, b = a[once], b[once]
        if not len(a):
            return None
        labels = labels_of(a, b, len(cls))
        sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.int32).reshape(len(cls), -1)
        for k in range(t):  # an earlier table has counted the pairs that meet there
            new = sig[a, k] != sig[b, k]
            a, b = a[new], b[new]
        links = np.bincount(a, n[b], len(cls)) + np.bincount(b, n[a], len(cls))
        some = np.flatnonzero((links > 0) | (labels != np.arange(len(cls))))
        return pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.array(links[some].astype(np.int64)), pa.array(cls[labels[some]])], ["cls", "links", "root"])

    found = settle(sorted_groups(met, ["t", "key", "i", "j"], compare, "cls long, links long, root long"), "vec-links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    facts = classes.select("cls", "n", "least").join(links, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    facts = facts.select("cls", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    least = facts.groupBy("root").agg(F.min("least").alias("component"))
    facts = settle(facts.join(least, "root").select("cls", "n_links", "component"), "vec-facts")
    discard(classes, hashed, found)
    out = keyed.select("vec_id", F.when(F.col("ok"), F.col("cls")).alias("cls")).join(facts, "cls", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
