"""Near-duplicate texts by DartMinHash over weighted shingles.

A text's elements are its five-word shingles, weighted by how often they occur (a text of fewer
words is one shingle). Darts are thrown at each element's region, weight by rank, cell by cell:
a Poisson number of darts a cell, all drawn from a hash of element and cell, so equal regions of two
texts hold equal darts. Darts under the element's weight and of small rank count; each falls on
one of ``SIZE`` coordinates and the earliest (least rank) a coordinate is kept. Two texts agree in a
coordinate with the probability of their weighted Jaccard similarity. The cost is that of about
SIZE * ln(SIZE) darts a text, not of SIZE hashes a shingle. Texts with an empty coordinate are done
again with twice the rank range.

Bands of ROWS coordinates make buckets. Texts with the same words are one class first. Candidates
are verified with exact similarities, first each against the bucket's least class (a star, linear in
the bucket's size), then, within buckets that still hold several components, members of different
components against each other, in pairs of blocks of bounded size. Pairs inside a component need
no look, as they can't change the classes. Components are found by joins. Buckets, pairs and blocks
are made of ids alone; a text's shingle hashes come in once it is known where they go, from a second
reading of the texts that a Bloom filter of fixed size lets through, and move twice (together with
those of equal rows, then to their block).

Null texts and texts without words are classes of their own. Repeated rows are copies. The class id
is the least doc_id of the class; a null id never is, unless all are null."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm import textkernel as K
from pagequarry.llm.common import bloom, bloom_hit, discard, map_text, settle, spare, text_key, tune
from pagequarry.llm.components import connected_components, sorted_groups
from pagequarry.llm.textkernel import mix64

SHINGLE = 5
THRESHOLD = 0.8
SIZE = 64
ROWS = 4
#: Unit of weight; it keeps both the weights and the ranks of usual texts in the first few cells.
UNIT = 1 / 2048
BLOCK = 512
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def shingles(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, ...]:
    """(text, hash, count) of the distinct shingles, sorted by text and hash; hashes of all words, and where
    each text's words start."""
    n = len(offs) - 1
    ws, we, wd = K.words(data, offs)
    wh = K.Rolling(data).ranges(ws, we)
    edge = np.searchsorted(wd, np.arange(n + 1))
    n_words = np.diff(edge)
    starts = K.window_starts(wd, size)
    roll = K.Rolling(wh)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    d = np.concatenate([wd[starts], short])
    h = np.concatenate([roll.windows(size)[starts], roll.ranges(edge[short], edge[short + 1])])
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.append(at, len(d))), wh, edge


def darts(doc: np.ndarray, h: np.ndarray, x: np.ndarray, limit: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, dart, rank) of all darts below weight x and rank limit[doc] of elements h."""
    out = []
    if not len(h):
        z = np.zeros(0)
        return z.astype(np.int64), z.astype(np.uint64), z
    r_max = limit[doc]
    for nu in range(int(math.log2(1 + t * x.max())) + 1):
        for rho in range(int(math.log2(1 + r_max.max())) + 1):
            w_low, r_low = (2**nu - 1) / t, 2**rho - 1
            dw, dr = 2**nu / t / 2**rho, 2**rho / 2**nu
            nw = np.clip(np.ceil((x - w_low) / dw), 0, 2**rho).astype(np.int64)
            nr = np.clip(np.ceil((r_max - r_low) / dr), 0, 2**nu).astype(np.int64)
            cells = nw * nr
            e = np.repeat(np.arange(len(h)), cells)
            if not len(e):
                continue
            at = np.arange(len(e)) - np.repeat(np.cumsum(cells) - cells, cells)
            w, r = at // nr[e], at % nr[e]
            cell = mix64(h[e] ^ mix64(((w.astype(np.uint64) << np.uint64(28)) ^ (r.astype(np.uint64) << np.uint64(8))) + np.uint64(nu * 64 + rho + 1)))
            many = np.searchsorted(_POISSON, (cell >> np.uint64(11)).astype(np.float64) / 2.0**53)
            for k in range(int(many.max(initial=0))):
                on = np.flatnonzero(many > k)
                z = mix64(cell[on] + np.uint64((0xD1B54A32D192ED03 * (k + 1)) & (2**64 - 1)))
                weight = w_low + dw * (w[on] + (z >> np.uint64(32)).astype(np.float64) / 2.0**32)
                rank = r_low + dr * (r[on] + (z & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32)
                ok = (weight < x[e[on]]) & (rank < r_max[e[on]])
                out.append((doc[e[on]][ok], mix64(z[ok] ^ h[e[on]][ok]), rank[ok]))
    return tuple(np.concatenate(c) for c in zip(*out))


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """(n, size) earliest darts; rows of texts without elements are zero."""
    t = size * math.log(size) + 2 * size
    x = count * UNIT
    total = np.bincount(doc, weights=x, minlength=n)
    out = np.zeros((n, size), np.uint64)
    todo, reach = np.flatnonzero(total > 0), 1.0
    while len(todo):
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        mine = place[doc] >= 0
        limit = np.zeros(n)
        limit[todo] = reach / total[todo]
        d, dart, rank = darts(doc[mine], h[mine], x[mine], limit, t)
        slot = place[d] * size + ((dart >> np.uint64(40)) % np.uint64(size)).astype(np.int64)
        least = np.full(len(todo) * size, np.inf)
        np.minimum.at(least, slot, rank)
        won = rank == least[slot]
        sig = np.zeros(len(todo) * size, np.uint64)
        sig[slot[won]] = dart[won]
        full = np.isfinite(least).reshape(-1, size).all(axis=1)
        out[todo[full]] = sig.reshape(-1, size)[full]
        todo, reach = todo[~full], reach * 2
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band, made different by the band's number."""
    keys = np.zeros((len(sig), sig.shape[1] // rows), np.uint64)
    for r in range(rows):
        keys = mix64(keys + sig[:, r::rows][:, : keys.shape[1]] + np.uint64(r + 1))
    return mix64(keys ^ mix64(np.arange(keys.shape[1], dtype=np.uint64))).view(np.int64)


def similarity(h1: np.ndarray, c1: np.ndarray, h2: np.ndarray, c2: np.ndarray) -> float:
    """Weighted Jaccard of two sorted sets."""
    _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    both = int(np.minimum(c1[i], c2[j]).sum())
    return both / max(1, int(c1.sum()) + int(c2.sum()) - both)


def _pack(h: np.ndarray, c: np.ndarray) -> bytes:
    """Number of hashes, hashes, and their counts unless all are one."""
    return np.uint64(len(h)).tobytes() + h.tobytes() + (c.astype(np.int64).tobytes() if (c > 1).any() else b"")


def _unpack(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(b, np.uint64, 1)[0])
    return np.frombuffer(b, np.uint64, n, 8), np.frombuffer(b, np.int64, n, 8 + 8 * n) if len(b) > 8 + 8 * n else np.ones(n, np.int64)


def _near(shared, size_a, size_b, threshold: float):
    """Whether shared is threshold of the union or more (a rounding error below counts as equal)."""
    return shared >= threshold * (size_a + size_b - shared) - 1e-9


def _star(g: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """Links (a, b) of the members of each group to its center, whose row has node = center."""
    node, center, blk = (g.column(c).to_numpy() for c in ("node", "center", "blk"))
    packed = g.column("elements").to_pylist()
    cuts = np.flatnonzero((center[1:] != center[:-1]) | (blk[1:] != blk[:-1])) + 1
    a, b = [], []
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(node)]):
        own = np.flatnonzero(node[lo:hi] == center[lo:hi])
        if not len(own) or hi - lo < 2:
            continue
        ch, cc = _unpack(packed[lo + own[0]])
        for k in range(lo, hi):
            if node[k] != center[k]:
                h, c = _unpack(packed[k])
                at = np.minimum(np.searchsorted(ch, h), len(ch) - 1)
                shared = int(np.where(ch[at] == h, np.minimum(c, cc[at]), 0).sum())
                if _near(shared, int(c.sum()), int(cc.sum()), threshold):
                    a.append(node[k])
                    b.append(center[k])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None


def _across(g: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """Links between the roots of a group's members; a pair of one root is not looked at."""
    names, r = np.unique(g.column("root").to_numpy(), return_inverse=True)
    if len(names) < 2:
        return None
    packed = [_unpack(y) for y in g.column("elements").to_pylist()]
    h, c = np.concatenate([p[0] for p in packed]), np.concatenate([p[1] for p in packed])
    size = np.array([p[1].sum() for p in packed])
    of = np.repeat(np.arange(len(packed)), [len(p[0]) for p in packed])
    _, u = np.unique(h, return_inverse=True)
    edge = np.searchsorted(of, np.arange(len(packed) + 1))
    largest = np.bincount(r).argmax()
    weight = np.zeros(u.max(initial=0) + 1, np.int64)
    links = set()
    for k in np.flatnonzero(r != largest):
        mine = slice(edge[k], edge[k + 1])
        weight[u[mine]] = c[mine]
        shared = np.bincount(of, weights=np.minimum(weight[u], c), minlength=len(packed))
        weight[u[mine]] = 0
        near = _near(shared, size, size[k], threshold)
        links |= {(min(r[k], q), max(r[k], q)) for q in np.unique(r[near]) if q != r[k]}
    if not links:
        return None
    a, b = zip(*sorted(links))
    return pa.RecordBatch.from_arrays([pa.array(names[list(a)], pa.int64()), pa.array(names[list(b)], pa.int64())], ["a", "b"])


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """doc_id, key (text_key of the row), class_id, class_size, kept for every row of df. kept marks one row of
    each class (repeated rows that can't be told apart are all marked). doc_id is read as a long."""
    spark = df.sparkSession
    tune(spark)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), text_key("doc_id", text).alias("key"))

    def sign(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = K.joined(part.column("text"))
        d, h, c, wh, edge = shingles(data, offs)
        keys = band_keys(signatures(d, h, c, part.num_rows))
        c1, c2 = (K.Rolling(wh, seed).ranges(edge[:-1], edge[1:]).view(np.int64) for seed in (0, 1))
        none = edge[1:] == edge[:-1]
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(c1, mask=none), pa.array(c2, mask=none), bands], ["doc_id", "key", "c1", "c2", "bands"])

    base = settle(map_text(docs, sign, "doc_id long, key long, c1 long, c2 long, bands array<long>"), "dart-signs")
    # a class has the words of its texts in common (124 bits); its node is the row whose text stands for it
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")).alias("least")
    classes = base.where("c1 IS NOT NULL").groupBy("c1", "c2").agg(least, F.min("key").alias("node"), F.count(F.lit(1)).alias("n"), F.any_value("bands").alias("bands"))
    classes = settle(classes, "dart-classes")
    entries = classes.select("node", F.explode("bands").alias("b"))
    stars = settle(entries.groupBy("b").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("m")).where("m > 1"), "dart-stars")
    met = settle(entries.where(bloom_hit(spark, "b", bloom(stars.select("b")))).join(stars, "b"), "dart-met")
    discard(stars)

    def elements(keys: DataFrame) -> DataFrame:
        """node, elements of the nodes in keys (some others may come too)."""

        def of(part: pa.RecordBatch) -> pa.RecordBatch:
            _, first = np.unique(part.column("key").to_numpy(), return_index=True)
            part = part.take(pa.array(np.sort(first)))
            d, h, c, _, _ = shingles(*K.joined(part.column("text")))
            edge = np.searchsorted(d, np.arange(part.num_rows + 1))
            return pa.RecordBatch.from_arrays([part.column("key"), pa.array([_pack(h[a:b], c[a:b]) for a, b in zip(edge, edge[1:])], pa.binary())], ["node", "elements"])

        found = map_text(docs.where(bloom_hit(spark, "key", bloom(keys))), of, "node long, elements binary")
        return found.groupBy("node").agg(F.any_value("elements").alias("elements"))  # repeated rows once

    # each member of a bucket against the bucket's center, in blocks of bounded size
    pairs = met.where("node <> center").select("node", "center").distinct()
    pairs = settle(pairs, "dart-pairs")
    blocks = pairs.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asked = pairs.join(blocks, "center").select("node", "center", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("blk"))
    asked = asked.unionByName(blocks.select(F.col("center").alias("node"), "center", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk")))
    asked = settle(asked, "dart-asked")
    rows = elements(asked.select("node")).join(asked, "node")
    first = settle(connected_components(sorted_groups(rows, ["center", "blk"], lambda g: _star(g, threshold), "a long, b long", together=True)), "dart-first")
    discard(pairs, asked)
    # buckets that hold several components still: compare across these (of two members, the star has compared all)
    rooted = met.select("node", "b").join(first, "node", "left").select("node", "b", F.coalesce("root", "node").alias("root"))
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    open_ = rooted.groupBy("b").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"), *marks).where("lo <> hi AND m > 2")
    open_ = open_.groupBy("m", "x1", "x2").agg(F.min("b").alias("b"))  # buckets of the same members are one
    open_ = settle(open_.select("b", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "dart-open")
    ids = rooted.join(open_, "b").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ids = settle(ids.select("b", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "root"), "dart-ids")
    rows = elements(ids.select("node")).join(ids, "node")
    second = settle(sorted_groups(rows, ["b", "i", "j"], lambda g: _across(g, threshold), "a long, b long").distinct(), "dart-across")
    again = settle(connected_components(second).select(F.col("node").alias("root"), F.col("root").alias("top")), "dart-again")
    roots = first.join(again, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = again.join(first.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    roots = settle(roots.unionByName(alone), "dart-roots")
    discard(met, first, open_, ids, second, again)
    # what a class of copies or a component says of its rows; most rows are in neither
    known = classes.select("c1", "c2", "least", "node", "n")
    linked = known.where(bloom_hit(spark, "node", bloom(roots.select("node")))).join(roots, "node")
    facts = linked.join(linked.groupBy("root").agg(F.min("least").alias("top"), F.sum("n").alias("size")), "root").select("c1", "c2", F.col("top").alias("least"), "size")
    copies = known.where("n > 1").join(roots, "node", "left_anti").select("c1", "c2", "least", F.col("n").alias("size"))
    facts = settle(facts.unionByName(copies), "dart-facts")
    discard(classes, roots)
    mine = base.select("doc_id", "key", "c1", "c2")
    some = F.coalesce(bloom_hit(spark, "key1", bloom(facts.select("c1"))), F.lit(False))
    mine = mine.withColumn("key1", F.coalesce("c1", F.lit(0))).withColumn("some", F.col("c1").isNotNull() & some)
    single = mine.where("NOT some").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    out = mine.where("some").join(facts, ["c1", "c2"], "left")
    out = out.select(
        "doc_id", "key", F.coalesce("least.doc_id", "doc_id").alias("class_id"), F.coalesce("size", F.lit(1)).alias("class_size"),
        (F.col("size").isNull() | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("key") == F.col("least.key")))).alias("kept"),
    )
    return single.unionByName(out)


def keep_one(df: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """df without all but one row of each class of near duplicates; repeated rows count as duplicates. All columns
    of df pass, whatever their names.

    Only rows that have a copy move: they are found by a Bloom filter, the others pass through."""
    names = [f"`{c}`" for c in df.columns]
    key, one = spare(df, "__key", "__one")
    facts = settle(near_duplicates(df, threshold, text).where("class_size > 1").select("key", "kept"), "dart-kept")
    keyed = df.withColumn(key, text_key("doc_id", text))
    hit = bloom_hit(df.sparkSession, key, bloom(facts.select("key")))
    alone, others = keyed.where(~hit), keyed.where(hit)
    lost = facts.where("NOT kept").select(F.col("key").alias(key)).distinct()
    twice = facts.where("kept").select(F.col("key").alias(key)).distinct().withColumn(one, F.lit(True))
    others = others.join(lost, key, "left_anti").join(twice, key, "left")
    once = others.where(F.col(one)).dropDuplicates([key])
    return alone.select(names).unionByName(once.select(names)).unionByName(others.where(F.col(one).isNull()).select(names))
