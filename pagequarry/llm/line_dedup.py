r"""Line dedup: a suffix array over sequences of line ids by distributed prefix doubling.

The lines with a word of a text are a sequence of ids (124 bits, ordered as numbers). Round j has the rank of each
suffix by its first 2**j lines: the number of suffixes that sort before it, from one range sort of the distinct
pairs (rank of the suffix, rank of the suffix 2**j / 2 lines on). Equal ranks are an interval of the suffix array
whose common prefix is 2**j lines at least. A suffix that is alone in its interval repeats nothing and leaves the
array, whose order is thus worked out for the repeated suffixes alone.

The depth is limited: a run counts once it has ``min_words`` words, so of the common prefix a suffix needs the least
number m of lines that has them, which is given by two ranks of 2**j <= m lines that overlap. Each such interval
keeps its first place (by doc_id, null last, then position); its other places are later copies. Those of successive
suffixes overlap and make up the maximal repeated runs, whose lines go. So each removed line has an equal one before
it that stays, or that goes for the same reason.

Rows of a text meet in one task to look their further ranks up; counts of pairs combine before their shuffle; joins
on a frequent pair are of settled tables, so AQE splits them. Removal reads a text again only if a Bloom filter of
fixed size lets it through.

Null texts stay null, empty ones empty. Lines without a word are neither compared nor removed. Rows
equal in doc_id and text are one document here: they are kept or cut alike. doc_id is read as a long.
Other columns pass, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm import textkernel as K
from pagequarry.llm.common import bloom, bloom_hit, discard, light, map_text, settle, spare, text_key, tune, without
from pagequarry.llm.components import sorted_groups
from pagequarry.llm.textkernel import mix64

MIN_WORDS = 20


def ranked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (a, b, n: how many suffixes have it; settled) with rank, the number of suffixes whose pair sorts before.

    A range sort deals the distinct pairs evenly, however often one occurs; sums of whole partitions (a row each)
    shift the sums within them. Also the table that holds the sorted pairs."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), pa.array(n)], ["a", "b", "part", "at", "n"])
            at = int(ends[-1]) if len(n) else at

    shape = "a long, b long, part int, at long, n long"
    t = settle(pairs.repartitionByRange("a", "b").sortWithinPartitions("a", "b").select("a", "b", "n").mapInArrow(number, shape), "lines-sorted")
    sizes = sorted((r["part"], r["n"]) for r in t.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row a partition
    starts = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).astype(int).tolist()
    shift = pairs.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "part int, shift long")
    return t.join(F.broadcast(shift), "part").select("a", "b", (F.col("at") + F.col("shift")).alias("rank")), t


def repeated_lines(df: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """key (text_key), runs: the maximal runs (first, m) of word lines (counted from 0) to remove."""
    spark = df.sparkSession
    tune(spark)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), text_key("doc_id", text).alias("key"))

    def ids(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = K.joined(part.column("text"))
        ls, le, ld = K.lines(data, offs)
        ws, _, _ = K.words(data, offs)
        words = np.bincount(np.searchsorted(ls, ws, side="right") - 1, minlength=len(ls))
        some = words > 0
        ls, le, ld, words = ls[some], le[some], ld[some], words[some]
        one, two = (K.Rolling(data, seed).ranges(ls, le).view(np.int64) for seed in (0, 1))
        first = np.searchsorted(ld, ld)
        pos = np.arange(len(ld)) - first
        # least m so that lines pos .. pos + m - 1 have min_words words; 0 where the text ends before
        sums = np.concatenate([[0], np.cumsum(words)])
        end = np.searchsorted(sums, sums[:-1] + min_words)
        last = np.searchsorted(ld, ld, side="right")
        m = np.where(end <= last, end - np.arange(len(ld)), 0)
        take = pa.array(ld)
        return pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("key").take(take), pa.array(pos.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(one), pa.array(two)], ["doc_id", "key", "pos", "m", "a", "b"])

    def ahead(length: int):
        """Rank of the suffix by length lines further on (b) and of that by m - length (e; -1: none, or m is for another round)."""

        def find(g: pa.Table) -> pa.RecordBatch:
            g = g.combine_chunks()
            key, pos, m, rank = (g.column(c).to_numpy() for c in ("key", "pos", "m", "rank"))
            place = lambda at: mix64(key.view(np.uint64) ^ mix64(at.astype(np.uint64) + np.uint64(1)))
            here = place(pos)
            order = np.argsort(here)

            def at(where: np.ndarray) -> np.ndarray:
                want = place(where)
                i = order[np.minimum(np.searchsorted(here, want, sorter=order), len(order) - 1)]
                return np.where(here[i] == want, rank[i], -1)

            mine = (m >= length) & (m < 2 * length)
            e = np.where(mine, at(np.where(mine, pos + m - length, pos)), -1)
            return pa.RecordBatch.from_arrays([*(g.column(c).chunk(0) for c in ("doc_id", "key", "pos", "m", "rank")), pa.array(at(pos + length)), pa.array(e)], ["doc_id", "key", "pos", "m", "a", "b", "e"])

        return find

    def next_ranks(t: DataFrame, name: str) -> DataFrame:
        """t (a, b of each suffix) with its rank by (a, b), less the suffixes that are alone."""
        pairs = settle(t.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"lines-pairs-{name}")
        both = F.xxhash64("a", "b")
        may = t.withColumn("both", both).where(bloom_hit(spark, "both", bloom(pairs.select(both.alias("both")))))
        ranks, held = ranked(pairs)
        spent.extend((pairs, held))
        return may.join(ranks, ["a", "b"]).select("doc_id", "key", "pos", "m", "rank")

    every = settle(map_text(docs, ids, "doc_id long, key long, pos int, m int, a long, b long"), "lines")
    deepest = every.agg(F.max("m").alias("m")).first()["m"] or 0
    spent, read = [every], []
    t, length, runs = next_ranks(every, "0"), 1, []
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key", "pos")
    while True:
        t = settle(sorted_groups(t, ["key"], ahead(length), "doc_id long, key long, pos int, m int, a long, b long, e long", together=True), f"lines-{length}")
        discard(*spent)
        spent.clear()
        # suffixes of equal ranks here and m - length lines on have m lines in common: an interval of the array
        exact = t.where("e >= 0").select("doc_id", "key", "pos", "m", "a", "e")
        heads = settle(exact.groupBy("a", "e", "m").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "lines-heads")
        later = exact.join(heads, ["a", "e", "m"]).where(~((F.col("key") == F.col("head.key")) & (F.col("pos") == F.col("head.pos")) & F.col("doc_id").eqNullSafe(F.col("head.doc_id"))))
        read += [t, heads]
        runs.append(later.select("key", F.col("pos").alias("first"), "m"))
        if deepest < 2 * length:
            break
        t = next_ranks(t.where("b >= 0"), str(2 * length))
        length *= 2
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)

    def maximal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs that overlap or touch as one."""
        for batch in batches:
            joined = []
            for parts in batch.column("runs").to_pylist():
                own: list[dict] = []
                for r in sorted(parts, key=lambda x: x["first"]):
                    if own and r["first"] <= own[-1]["first"] + own[-1]["m"]:
                        own[-1]["m"] = max(own[-1]["m"], r["first"] + r["m"] - own[-1]["first"])
                    else:
                        own.append({"first": r["first"], "m": r["m"]})
                joined.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(joined, batch.schema.field("runs").type)], ["key", "runs"])

    of_text = out.groupBy("key").agg(F.collect_set(F.struct("first", "m")).alias("runs"))
    found = settle(of_text.mapInArrow(maximal, "key long, runs array<struct<first:int,m:int>>"), "lines-runs")
    discard(*spent, *read)
    return found


def dedup_lines(df: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """df with text less the lines of later copies, and n_lines (with a word, before) and n_removed_lines;
    columns of the two names are replaced."""
    df = without(df, "n_lines", "n_removed_lines")
    names = df.columns
    own = [f"`{c}`" for c in names]
    key, runs_of = spare(df, "__key", "__runs")
    runs = repeated_lines(df, min_words, text)
    keyed = df.withColumn(key, text_key("doc_id", text))
    hit = bloom_hit(df.sparkSession, key, bloom(runs.select("key")))
    count = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D][^\n]*")), F.lit(0)).cast("long")
    alone = keyed.where(~hit).select(*own, count.alias("n_lines"), F.lit(0).cast("long").alias("n_removed_lines"))
    touched = keyed.where(hit).join(light(runs).select(F.col("key").alias(key), F.col("runs").alias(runs_of)), key, "left").select(*own, runs_of)

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, total, gone = [], [], []
        for t, rs in zip(part.column(text).to_pylist(), part.column(runs_of).to_pylist()):
            lines = (t or "").encode().split(b"\n")
            at = [i for i, x in enumerate(lines) if x.split()]
            dead = {at[k] for r in rs or () for k in range(r["first"], min(r["first"] + r["m"], len(at)))}
            texts.append(t if t is None or not dead else b"\n".join(x for i, x in enumerate(lines) if i not in dead).decode())
            total.append(len(at))
            gone.append(len(dead))
        cols = [pa.array(texts, pa.string()) if n == text else part.column(n) for n in names]
        return pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_removed_lines"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return alone.unionByName(map_text(touched, cut, f"{kinds}, n_lines long, n_removed_lines long", text))
