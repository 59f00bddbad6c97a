"""Shared plumbing: batch mapping over text, tables in the shared folder, Bloom filters."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.textkernel import forget_powers, mix64

#: Rows of one Arrow batch; with long texts this bounds what a Python worker holds.
BATCH_ROWS = 256
#: Bytes of text that one call of a kernel sees (one longer text is a call of its own).
SLICE_BYTES = 1 << 18
#: Compressed bytes of a table that may be broadcast.
LIGHT_BYTES = 1 << 21
BLOOM_BITS = 1 << 26
BLOOM_PAGE = 1 << 12


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a worker's memory follows SLICE_BYTES and not the row count. Python
    workers also look for this package where the driver has it (a cluster may ship it by --py-files)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local master has one of its own (tests);
    on a cluster that would be a folder on each machine, so there it is an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (conf or "file:///tmp/checkpoints").rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagequarry-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def _place(t: DataFrame):
    """(file system, path) of a settled table."""
    jvm = t.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(t.settled_at)
    return path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()), path


def light(t: DataFrame) -> DataFrame:
    """A settled table, to be broadcast if its files are small enough that it takes a few MB at most."""
    files, path = _place(t)
    return F.broadcast(t) if files.getContentSummary(path).getLength() <= LIGHT_BYTES else t


def discard(*tables: DataFrame) -> None:
    """Delete settled tables. Only for those from which no unsettled table is still to be made: a lost executor's
    work is done again from what is settled."""
    for t in tables:
        files, path = _place(t)
        files.delete(path, True)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release_memory() -> None:
    """Give what a task has freed back to the system, as its Python worker stays for the next one."""
    forget_powers()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def row_slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about SLICE_BYTES of text each."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // SLICE_BYTES
    cuts = np.flatnonzero(np.diff(group)) + 1
    edges = [0, *cuts.tolist(), n]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str, text: str = "text") -> DataFrame:
    """Apply fn to bounded slices of df's rows; fn returns rows of schema, or None for none."""
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, text):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]
        release_memory()

    return df.mapInArrow(run, schema)


def text_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Key of a row by its id and text, so that repeated ids and null ids stay apart."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("\x00null")), F.coalesce(F.col(text), F.lit("\x00null")))


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns of these names, whatever the case (as Spark reads them)."""
    gone = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in gone])


def _bloom_slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(keys.astype(np.int64).view(np.uint64))
    return (h & np.uint64(BLOOM_BITS - 1)).astype(np.int64), (h >> np.uint64(38)).astype(np.int64)


def bloom(keys: DataFrame) -> np.ndarray:
    """Bit map of a long column's values. Its size is fixed (BLOOM_BITS, 8 MB), whatever the table's size:
    too many keys only raise the share of rows that pass; none that should pass is lost."""
    name = keys.columns[0]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS // 8, np.uint8)
        for b in batches:
            k = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            for slot in _bloom_slots(k):
                np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        pages = bits.reshape(-1, BLOOM_PAGE)
        hit = np.flatnonzero(pages.any(axis=1))
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array([pages[i].tobytes() for i in hit], pa.binary())], ["page", "bits"])
        del bits, pages
        release_memory()

    def union(group: pa.Table) -> pa.Table:
        bits = np.zeros(BLOOM_PAGE, np.uint8)
        for b in group.column("bits").to_pylist():
            bits |= np.frombuffer(b, np.uint8)
        return pa.table({"page": pa.array([group.column("page")[0].as_py()], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    pages = keys.select(name).mapInArrow(partial, "page long, bits binary").groupBy("page").applyInArrow(union, "page long, bits binary").collect()
    out = np.zeros((BLOOM_BITS // 8 // BLOOM_PAGE, BLOOM_PAGE), np.uint8)
    for r in pages:
        out[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def bloom_has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    a, b = _bloom_slots(keys)
    return ((bits[a >> 3] >> (a & 7)) & (bits[b >> 3] >> (b & 7)) & 1).astype(bool)


def bloom_hit(spark: SparkSession, key: str, bits: np.ndarray) -> Column:
    """Whether the long column key is in the Bloom filter (never false for one that is). Only the key goes to Python."""
    tune(spark)
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def hit(keys: pd.Series) -> pd.Series:
        return pd.Series(bloom_has(shared.value, keys.to_numpy()))

    return hit(F.col(key))
