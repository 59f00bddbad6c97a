"""Repeated substrings of at least WIDTH bytes, by a depth-limited radix sort of sampled suffixes.

Sorting every suffix would move each text hundreds of times over. Instead each window of WIDTH bytes
names one suffix in it: the place of the gram (GRAM bytes) with the least hash, the leftmost of
equals. Equal windows name suffixes at the same offset, so repeated windows are found among windows
whose suffixes are equal so far, and successive windows mostly name the same suffix (about two in
WIDTH - GRAM). The sort then works by most significant digits, and a suffix alone in its group goes:

1. the gram at the suffix itself;
2. all that the suffix's windows cover, as one digit: members of a group of two or more are repeated
   whole;
3. for one member of each remaining group, window by window (offset and the window's content), up to
   WIDTH bytes and no further. Groups left with two or more members are exactly the repeated windows.

Pass 3 reads the bytes of those members alone. Groups of up to GROUP members are sorted in one task;
larger ones (a passage that a third of all texts share, in different surroundings) are counted as
rows by offset and content, with partial sums before the shuffle. Windows of a slice that are equal
to each other are settled in place and sent on once. A text is read again only where a Bloom filter
of fixed size lets it through.

A sequence is the UTF-8 bytes of a text or, by another ``unit``, its words. What counts as repeated is a
window that starts anywhere else too or, with ``across``, one that another document has too: then groups are
told by the least and the greatest document in place of a count.

A null text is empty; matches never cross texts and may overlap. Rows are known by doc_id and text:
repeated rows repeat each other and are removed whole if they are long enough; across documents they
are one. Empty and short texts have no window. A text is read whole, however long."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm import textkernel as K
from pagequarry.llm.common import bloom, bloom_hit, discard, map_text, settle, text_key, tune
from pagequarry.llm.components import sorted_groups
from pagequarry.llm.textkernel import mix64

WIDTH = 400
GRAM = 128
GROUP = 2048
#: A passage is so many words that another document has too.
PASSAGE = 51
PASSAGE_GRAM = 12
_U32 = np.uint64(32)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w successive values."""
    n = len(v)
    blocks = np.concatenate([v, np.full(-n % w, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def sampled(data: np.ndarray, offs: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that name the same suffix: text, first and last window, suffix (positions in data),
    hash of the gram, hash of all bytes the windows cover."""
    z = np.zeros(0, np.int64)
    if len(data) < width:
        return z, z, z, z, z, z
    roll = K.Rolling(data)
    g = roll.windows(gram)
    least = sliding_min((g >> _U32 << _U32) | np.arange(len(g), dtype=np.uint64), width - gram + 1)
    long = offs[1:] - offs[:-1] >= width
    edge = np.zeros(len(data) + 2, np.int32)
    edge[offs[:-1][long]] += 1
    edge[offs[1:][long] - width + 1] -= 1
    p = np.flatnonzero(np.cumsum(edge[: len(least)]))
    if not len(p):
        return z, z, z, z, z, z
    a = (least[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]))
    first, last, a = p[new], p[np.append(new[1:], len(p)) - 1], a[new]
    whole = roll.ranges(first, last + width) ^ mix64((a - first).astype(np.uint64))
    return np.searchsorted(offs, first, side="right") - 1, first, last, a, g[a].view(np.int64), whole.view(np.int64)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals sorted by text and start whose ends ascend too."""
    if not len(doc):
        return doc, start, end
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])])
    at = np.flatnonzero(new)
    return doc[at], start[at], end[np.append(at[1:], len(doc)) - 1]


def _runs(flags: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of true flags with equal key."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (key[at[1:]] != key[at[:-1]])])
    i = np.flatnonzero(new)
    return at[i], at[np.append(i[1:], len(at)) - 1]


def window_hashes(pieces: list[bytes], width: int, kind=np.uint8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, hash) of every window of each piece."""
    data = np.frombuffer(b"".join(pieces), kind)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in pieces])]) // np.dtype(kind).itemsize
    n = np.diff(offs) - width + 1
    of = np.repeat(np.arange(len(pieces)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start = offs[of] + at
    return of, at, K.Rolling(data).ranges(start, start + width)


def _sequence(column: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts one after another, and offsets."""
    data, offs = K.joined(column)
    if unit == "bytes":
        return data, offs
    ws, we, wd = K.words(data, offs)
    return K.Rolling(data).ranges(ws, we), np.searchsorted(wd, np.arange(len(offs)))


def repeated_spans(df: DataFrame, width: int = WIDTH, gram: int = GRAM, group: int = GROUP, text: str = "text", unit: str = "bytes", across: bool = False) -> DataFrame:
    """key (text_key), spans: list of (start, stop) ranges in units, not merged, that repeated windows cover."""
    tune(df.sparkSession)
    docs = df.select(F.col(text).alias("text"), text_key("doc_id", text).alias("key"))
    kind = np.uint8 if unit == "bytes" else np.uint64
    tally = ["lo", "hi"] if across else ["n"]
    total = [F.min("lo").alias("lo"), F.max("hi").alias("hi")] if across else [F.sum("n").alias("n")]
    many = F.col("lo") != F.col("hi") if across else F.col("n") > 1

    def sample(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = _sequence(part.column("text"), unit)
        doc, first, last, a, g, whole = sampled(data, offs, width, gram)
        same = mix64(g.view(np.uint64)) ^ whole.view(np.uint64)
        key = part.column("key").to_numpy()
        if across:  # successive windows that are equal, as in a stutter, are one row
            twice, keep = np.zeros(len(doc), bool), np.ones(len(doc), bool)
            keep[1:] = (same[1:] != same[:-1]) | (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + 1)
            more = np.diff(np.append(np.flatnonzero(keep), len(keep))) - 1
        else:
            twice, later = K.repeated(same)
            keep = ~later
            more = np.zeros(int(keep.sum()), np.int64)
        d, s, e = merged(doc[twice], first[twice], last[twice] + width)
        n1, n2 = int(keep.sum()), len(d)
        i32 = lambda x, y: pa.array(np.concatenate([x, y]).astype(np.int32))
        at, at2 = offs[doc[keep]], offs[d]
        none = np.arange(n1 + n2) >= n1
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([key[doc[keep]], key[d]])), i32(1 + twice[keep], np.full(n2, 2)),
            pa.array(np.concatenate([g[keep], np.zeros(n2, np.int64)]), mask=none), pa.array(np.concatenate([whole[keep], np.zeros(n2, np.int64)]), mask=none),
            i32(first[keep] - at, s - at2), i32(last[keep] - at, e - width - at2), i32(a[keep] - at, s - at2), i32(more, np.zeros(n2, np.int64)),
        ], ["key", "n", "gram", "whole", "first", "last", "suffix", "more"])

    t = settle(map_text(docs, sample, "key long, n int, gram long, whole long, first int, last int, suffix int, more int"), f"suffixes-{unit}")
    known = t.where("gram IS NULL").select("key", F.col("first").alias("start"), (F.col("last") + width).alias("stop"))
    rows = t.where("gram IS NOT NULL").withColumns({"lo": F.col("key"), "hi": F.col("key")} if across else {})
    # first digit
    spark = df.sparkSession
    alike = settle(rows.groupBy("gram").agg(*total).where(many).select("gram"), "suffixes-0")
    t1 = settle(rows.where(bloom_hit(spark, "gram", bloom(alike))).join(alike, "gram", "left_semi"), "suffixes-1")
    # second digit
    member = F.struct("key", "first", "last", "suffix")
    groups = settle(t1.groupBy("gram", "whole").agg(*total, F.min(member).alias("m")), "suffixes-2")
    full = groups.where(many).select("gram", "whole")
    spans = t1.join(full, ["gram", "whole"], "left_semi").select("key", F.col("first").alias("start"), (F.col("last") + F.col("more") + width).alias("stop"))
    # the remaining digits, for one member of each group
    kinds = settle(groups.groupBy("gram").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "suffixes-kinds")
    ragged = groups.join(kinds, "gram").select("gram", "whole", *(tally if across else [F.least("n", F.lit(2)).cast("int").alias("n")]), "members", "m.*")
    by_doc = ragged.groupBy("key").agg(F.collect_list(F.struct("gram", "whole", *tally, "members", "first", "last", "suffix")).alias("parts"))  # of one text
    by_doc = settle(by_doc, "suffixes-3")
    some = docs.where(bloom_hit(spark, "key", bloom(by_doc.select("key")))).join(by_doc, "key")
    tallies = ", ".join(f"{c} {'long' if across else 'int'}" for c in tally)

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = part.column("parts")
        flat = rows.flatten()
        col = lambda c: flat.field(c).to_numpy()
        of = np.repeat(np.arange(part.num_rows), np.diff(rows.offsets.to_numpy()))
        data, offs = _sequence(part.column("text"), unit)
        first, last = col("first"), col("last")
        piece = [data[a : b + width].tobytes() for a, b in zip(offs[of] + first, offs[of] + last)]
        names = ["gram", "whole", *tally, "members"]
        return pa.RecordBatch.from_arrays([*(flat.field(c) for c in names), pa.array(col("suffix") - first), pa.array(piece, pa.binary())], [*names, "into", "piece"])

    pieces = settle(map_text(some.select("key", "text", "parts"), cut, f"gram long, whole long, {tallies}, members long, into int, piece binary"), "suffixes-4")

    def compare(g: pa.Table) -> pa.RecordBatch | None:
        g = g.combine_chunks()
        of, at, h = window_hashes(g.column("piece").to_pylist(), width, kind)
        into, gr = g.column("into").to_numpy(), g.column("gram").to_numpy()
        alike = mix64(h ^ mix64((into[of] - at).astype(np.uint64) ^ mix64(gr[of].view(np.uint64))))
        order = np.argsort(alike, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], alike[order][1:] != alike[order][:-1]]))
        group_of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
        counts = [g.column(c).to_numpy() for c in tally]
        hit = np.zeros(len(of), bool)
        if across:
            lo, hi = (f.reduceat(x[of[order]], head) for f, x in zip((np.minimum, np.maximum), counts))
            hit[order], single = (lo != hi)[group_of], counts[0] == counts[1]
        else:
            hit[order], single = (np.add.reduceat(counts[0][of[order]], head) > 1)[group_of], counts[0] == 1
        a, b = _runs(hit & single[of], of)
        if not len(a):
            return None
        whole = g.column("whole").to_numpy()[of[a]]
        return pa.RecordBatch.from_arrays([pa.array(gr[of[a]]), pa.array(whole), pa.array(at[a].astype(np.int32)), pa.array((at[b] + width).astype(np.int32))], ["gram", "whole", "start", "stop"])

    small = sorted_groups(pieces.where(F.col("members") <= group), ["gram"], compare, "gram long, whole long, start int, stop int", together=True)

    def explode(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                s = b.slice(i, 64)
                of, at, h = window_hashes(s.column("piece").to_pylist(), width, kind)
                col = lambda c: s.column(c).to_numpy()[of]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(col("gram")), pa.array((col("into") - at).astype(np.int32)), pa.array(h.view(np.int64)), *(pa.array(col(c)) for c in tally), pa.array(col("whole")), pa.array(at.astype(np.int32))], ["gram", "d", "h", *tally, "whole", "start"])

    rows = pieces.where(F.col("members") > group).mapInArrow(explode, f"gram long, d int, h long, {tallies}, whole long, start int")
    common = rows.groupBy("gram", "d", "h").agg(*total).where(many).select("gram", "d", "h")
    large = rows.where(~many).join(common, ["gram", "d", "h"], "left_semi").select("gram", "whole", "start", (F.col("start") + width).alias("stop"))
    # what holds for the member holds at the same distances for all of its group
    hits = small.unionByName(large).join(t1.select("gram", "whole", "key", "first", "more"), ["gram", "whole"])
    hits = hits.select("key", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("more") + F.col("stop")).alias("stop"))
    every = known.unionByName(spans).unionByName(hits)
    out = settle(every.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "suffixes-spans")  # of one text
    discard(t, alike, t1, groups, kinds, by_doc, pieces)
    return out


def passages(df: DataFrame, words: int = PASSAGE, text: str = "text") -> DataFrame:
    """key (text_key), n_passage_words: words of the text within windows of so many words that another document has
    too, for the texts that have any."""
    spans = repeated_spans(df, words, PASSAGE_GRAM, text=text, unit="words", across=True)
    fresh = lambda a, x: F.greatest(x["stop"] - F.greatest(a["end"], x["start"]), F.lit(0))
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["stop"]).alias("end"), (a["n"] + fresh(a, x)).alias("n"))
    return spans.select("key", F.aggregate(F.array_sort("spans"), state, step, lambda a: a["n"]).alias("n_passage_words"))


def remove_repeats(df: DataFrame, width: int = WIDTH, text: str = "text", texts: bool = True, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if texts, kept (binary: the remaining bytes); with
    passage (a number of words) n_passage_words, which removes nothing."""
    docs = df.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"), text_key("doc_id", text).alias("key"))
    facts = repeated_spans(df, width, text=text)
    if passage:
        facts = settle(facts.join(passages(df, passage, text), "key", "full"), "suffixes-facts")
    hit = bloom_hit(df.sparkSession, "key", bloom(facts.select("key")))
    size, whole, zero = F.octet_length("text").cast("long"), F.encode("text", "UTF-8"), F.lit(0).cast("long")
    extra = [whole.alias("kept")] * texts + [zero.alias("n_passage_words")] * bool(passage)
    alone = docs.where(~hit).select("doc_id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256"), *extra)
    id_type = df.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts + ["n_passage_words"] * bool(passage)

    def remove(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, s in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
            raw, gone, n, end, kept = t.encode(), 0, 0, 0, []
            for a, b in sorted((x["start"], x["stop"]) for x in s or ()):
                if a > end or not n:  # ranges that touch are one run
                    kept.append(raw[end:a])
                    n, gone, end = n + 1, gone + b - a, b
                elif b > end:
                    gone, end = gone + b - end, b
            kept.append(raw[end:])
            left = b"".join(kept)
            out.append((len(raw), gone, n, hashlib.sha256(left).hexdigest(), left))
        cols = list(zip(*out))
        arrays = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3])]
        arrays += [pa.array(cols[4], pa.binary())] * texts + part.columns[3:]
        return pa.RecordBatch.from_arrays(arrays, names)

    more = [F.coalesce("n_passage_words", zero).alias("n_passage_words")] * bool(passage)
    touched = docs.where(hit).join(facts, "key", "left").select("doc_id", "text", "spans", *more)
    kinds = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts + ", n_passage_words long" * bool(passage)
    return alone.unionByName(map_text(touched, remove, kinds))
