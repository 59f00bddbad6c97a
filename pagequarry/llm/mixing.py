r"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mixture draws the golden-ratio point frac(i * phi), maps it through the cumulative
weights of the sources, and is its source's r-th slot. Each source's documents are shuffled (by a
hash), laid end to end and cut into blocks of ``block`` words; slot r takes block r mod (number of
blocks), so a source that gives more than it has goes round again. A source stops at its target,
its last block cut short, and what the schedule owes it in the end is topped up, so that the words
taken meet the target to the word.

A document's size is its number of runs of [^\x20\x09-\x0D] (null text: 0). Documents, slots and
blocks stay distributed: ranks and positions are sums within bounded buckets plus prefix sums over
bucket totals, so no source has to fit in a task. One row a source reaches the driver, of at most
MAX_SOURCES; more sources stay distributed, and as what the slots take of a source is whole rounds and
then the first words of one more, that is worked out source by source without the slots, with the same
result. Documents without words take nothing; repeated rows are separate documents; a null source is a
source of its own, the last one. Very long texts are counted where they are. Ties of the shuffling hash
go by doc_id."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.llm.common import settle, text_key, tune
from pagequarry.operators.frontier import sorted_rank

BLOCK = 64
CYCLE = (1, 2, 3)
#: A target is at most so many times its source's size.
MOST = 3
MAX_SOURCES = 100_000
CHUNK = 1 << 16
BUCKET_DOCS = 1024
SPAN = 1024
_PHI = np.uint64(0x9E3779B97F4A7C15)


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST) -> np.ndarray:
    """Shares of the sum of sizes by weight; what is above most * size goes to the others by weight."""
    cap, w = np.asarray(sizes, float) * most, np.asarray(weights, float)
    total, out, free = float(np.sum(np.asarray(sizes, float))), np.zeros(len(cap)), np.ones(len(cap), bool)
    while free.any():
        level = (total - cap[~free].sum()) / w[free].sum()
        over = free & (level * w > cap)
        if not over.any():
            out[free] = level * w[free]
            break
        free &= ~over
    out[~free] = cap[~free]
    return out


@dataclass(frozen=True)
class Plan:
    """By source, in code point order, null last."""

    names: list[str | None]
    sizes: np.ndarray
    targets: np.ndarray
    block: int

    @property
    def blocks(self) -> np.ndarray:
        return -(-self.sizes // self.block)

    @property
    def words(self) -> np.ndarray:
        return np.minimum(np.rint(self.targets).astype(np.int64), MOST * self.sizes)

    @property
    def slots(self) -> np.ndarray:
        """Slots that each source needs for its words: whole rounds, then blocks of another."""
        size = np.maximum(self.sizes, 1)
        return self.words // size * self.blocks + -(-(self.words % size) // self.block)

    @property
    def last(self) -> np.ndarray:
        """Words of the last slot if that is cut short, else 0."""
        return (self.words % np.maximum(self.sizes, 1)) % self.block


def plan(docs: DataFrame, block: int = BLOCK) -> Plan | None:
    """docs: source, size. None if there are more than MAX_SOURCES sources."""
    rows = docs.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        return None
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = np.array([r["n"] or 0 for r in rows], np.int64)
    weights = [CYCLE[i % len(CYCLE)] for i in range(len(rows))]
    return Plan([r["source"] for r in rows], sizes, targets(sizes, weights), block)


def mix_many(docs: DataFrame) -> DataFrame:
    """What mix_documents says, with the sources as a table: a source's words are whole rounds of it and the first
    words of one more round, whatever the order of slots among sources."""
    sizes = docs.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")).withColumn("no", F.col("source").isNull())
    weight = F.get(F.array(*[F.lit(float(w)) for w in CYCLE]), (F.col("s") % len(CYCLE)).cast("int"))
    table = sorted_rank(sizes, ["no", "source"], "s").withColumn("s", F.col("s").cast("int")).withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * MOST)
    total, level, last = float(table.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while True:  # sources at their cap only become more, so this ends
        over = F.col("w") * level > F.col("cap")
        n, held, free = table.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        if n == last or not free:
            break
        level, last = (total - held) / free, n
    table = settle(table.select("source", "s", "source_size", F.least(F.col("w") * level, "cap").alias("target")), "mix-sources")
    placed = place(docs.join(table.select("source", "s").withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name"))
    words = F.least(F.rint("target").cast("long"), F.col("source_size") * MOST)
    both = placed.join(table.drop("source"), "s").withColumn("words", words).withColumn("round", F.greatest("source_size", F.lit(1)))
    rest = F.col("words") % F.col("round") - F.col("start")
    taken = F.expr("words div round") * F.col("size") + F.greatest(F.least(rest, "size"), F.lit(0))
    return both.select("doc_id", "source", "key", "size", "source_size", "target", taken.alias("taken"))


def chunk_sources(chunk: int, n_slots: int, edges: np.ndarray) -> np.ndarray:
    """Source of each slot of a chunk."""
    i = np.arange(chunk * CHUNK, min((chunk + 1) * CHUNK, n_slots)).astype(np.uint64)
    x = (i * _PHI).astype(np.float64) / 2.0**64
    return np.minimum(np.searchsorted(edges, x, side="right"), len(edges) - 1)


def schedule(docs: DataFrame, p: Plan) -> DataFrame:
    """slot, s (source's number), rank (of the slot in its source), block, words (taken from the block's start; null: all)."""
    spark = docs.sparkSession
    need = p.slots
    n = int(need.sum())
    shape = "slot long, s int, rank long, block long, words long"
    if not n:
        return spark.createDataFrame([], shape)
    edges = np.cumsum(need) / n
    chunks = spark.range(0, -(-n // CHUNK), 1, min(max(1, -(-n // CHUNK)), 4096)).withColumnRenamed("id", "chunk")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0).to_pylist():
                k = np.bincount(chunk_sources(c, n, edges), minlength=len(edges))
                s = np.flatnonzero(k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), c)), pa.array(s.astype(np.int32)), pa.array(k[s].astype(np.int64))], ["chunk", "s", "k"])

    counts = settle(chunks.mapInArrow(count, "chunk long, s int, k long"), "mix-slots")
    starts = before(counts, "chunk", "k").groupBy("chunk").agg(F.collect_list(F.struct("s", "before")).alias("starts"))  # one entry a source at most
    blocks, last = p.blocks, p.last

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, given in zip(b.column("chunk").to_pylist(), b.column("starts").to_pylist()):
                base = np.zeros(len(edges), np.int64)
                for g in given:
                    base[g["s"]] = g["before"]
                src = chunk_sources(c, n, edges)
                order = np.argsort(src, kind="stable")
                first = np.searchsorted(src[order], np.arange(len(edges)))
                r = np.empty(len(src), np.int64)
                r[order] = np.arange(len(src)) - first[src[order]]
                r += base[src]
                ok = r < need[src]
                yield rows_of(np.flatnonzero(ok) + c * CHUNK, src[ok], r[ok])

    def rows_of(slot: np.ndarray, src: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
        short = (r == need[src] - 1) & (last[src] > 0)
        return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(src.astype(np.int32)), pa.array(r), pa.array(r % blocks[src]), pa.array(last[src], mask=~short)], ["slot", "s", "rank", "block", "words"])

    out = starts.mapInArrow(rank, shape)
    got = {r["s"]: r["k"] for r in counts.groupBy("s").agg(F.sum("k").alias("k")).collect()}  # one row a source
    owed = [(s, r) for s in range(len(need)) for r in range(got.get(s, 0), int(need[s]))]
    if owed:  # the schedule's discrepancy, a few slots a source
        s, r = np.array(owed).T
        out = out.unionByName(spark.createDataFrame(rows_of(n + np.arange(len(s)), s, r).to_pandas().astype({"words": "Int64"}).astype(object).where(lambda d: d.notna(), None).values.tolist(), shape))
    return out


def before(df: DataFrame, at: str, value: str) -> DataFrame:
    """df (s, at, value; a row for each s and at) with before: the sum of value over smaller at of the same s. Sums of
    SPAN neighbours come first, so that no task sees all of a large source."""
    span = df.withColumn("span", F.expr(f"{at} div {SPAN}"))
    up = lambda w, v: F.coalesce(F.sum(v).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = span.groupBy("s", "span").agg(F.sum(value).alias("all")).withColumn("base", up(W.partitionBy("s").orderBy("span"), "all")).drop("all")
    inner = span.withColumn("own", up(W.partitionBy("s", "span").orderBy(at), value))
    return inner.join(spans, ["s", "span"]).withColumn("before", F.col("base") + F.col("own")).drop("span", "base", "own")


def layout(docs: DataFrame, p: Plan) -> DataFrame:
    """docs (doc_id, source, size, key) with s and start, the document's place in its shuffled source."""
    names = docs.sparkSession.createDataFrame([(i, n) for i, n in enumerate(p.names)], "s int, name string")
    return place(docs.join(F.broadcast(names) if len(p.names) < 10_000 else names, F.col("source").eqNullSafe(F.col("name"))).drop("name"))


def place(d: DataFrame) -> DataFrame:
    """d (s, doc_id, size, key) with start, the words before the document in its source, shuffled by a hash."""
    n_buckets = max(1, d.count() // BUCKET_DOCS)
    d = d.withColumn("mixed", F.xxhash64("key", F.lit(17))).withColumn("bucket", F.pmod("mixed", F.lit(n_buckets)))
    sums = before(d.groupBy("s", "bucket").agg(F.sum("size").alias("n")), "bucket", "n").select("s", "bucket", F.col("before").alias("base"))
    inner = W.partitionBy("s", "bucket").orderBy("mixed", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("upto", F.sum("size").over(inner))
    return d.join(sums, ["s", "bucket"]).withColumn("start", F.col("base") + F.col("upto") - F.col("size")).drop("mixed", "bucket", "upto", "base")


def mix_documents(df: DataFrame, block: int = BLOCK, text: str = "text") -> DataFrame:
    """doc_id, source, key (text_key of the row), size, source_size, target (of its source), taken (words
    the mixture takes of the document, repeats counted)."""
    spark = df.sparkSession
    tune(spark)
    docs = settle(df.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"), text_key("doc_id", text).alias("key")), "mix-docs")
    p = plan(docs, block)
    if p is None:
        return mix_many(docs)
    placed = settle(layout(docs, p), "mix-layout")
    facts = spark.createDataFrame([(i, int(n), float(t)) for i, (n, t) in enumerate(zip(p.sizes, p.targets))], "s int, source_size long, target double")
    used = schedule(docs, p).groupBy("s", "block").agg(F.count_if(F.col("words").isNull()).alias("full"), F.coalesce(F.sum("words"), F.lit(0)).alias("short"))
    pieces = placed.where("size > 0").select("s", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    pieces = pieces.withColumn("lo", F.greatest(F.col("start") - F.col("block") * block, F.lit(0))).withColumn("hi", F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block)))
    taken = F.col("full") * (F.col("hi") - F.col("lo")) + F.least("hi", "short") - F.least("lo", "short")
    took = pieces.join(used, ["s", "block"]).groupBy("s", "start").agg(F.sum(taken).alias("taken"))
    # a document with words is alone at its start
    both = placed.join(took.withColumn("some", F.lit(True)), (placed["s"] == took["s"]) & (placed["start"] == took["start"]) & (placed["size"] > 0), "left").select(placed["*"], F.coalesce("taken", F.lit(0)).alias("taken"))
    both = both.join(F.broadcast(facts) if len(p.names) < 10_000 else facts, "s")
    return both.select("doc_id", "source", "key", "size", "source_size", "target", "taken")
