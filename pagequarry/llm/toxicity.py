"""Toxicity by a factorization machine over hashed terms.

score(x) = sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>) over the distinct terms of a text, so
that two terms together (an insult and whom it is aimed at) can count for more than the sum of
both. Terms are lower-cased words and their 4- and 5-byte beginnings (for inflected insults),
hashed into 2**22 slots. A slot comes into the model by itself, as one of the ``max_terms`` whose presence
says most about the label (half of the G statistic over the training texts, at least ``min_gain``, as chance
alone makes many), or by a pair: a first model gives each training text its chance to be toxic, and pairs
of slots whose texts deviate from that bring in both, however neutral each is alone. All pairs
of the slots in ``min_texts`` texts are tested, so their gain has to be larger by the log of their number.
Slots whose texts all together can't reach it are left out first, by a bound that loses no pair.

Training sees at most ``max_labels`` labelled documents (smallest hash of the id), one text each, max_terms slots
and the slots of max_terms pairs, so what the model holds is bounded; scoring is one narrow pass. Null and empty
texts score sigmoid(b). Without labels of both classes every score is the share of toxic labels. Of rows that share
a doc_id the least text is learned from, of labels that share one the least label; all such rows are scored. Rows
with a null doc_id are never learned from. Equal texts get equal scores. A column score or predicted of the input,
in whatever case, is replaced."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm import textkernel as K
from pagequarry.llm.common import map_text, settle, without
from pagequarry.llm.quality_classifier import training_rows

SLOT_BITS = 22
PREFIXES = (4, 5)
RANK = 8
#: Slots whose pairs are counted at once.
PAIR_BLOCK = 1024


def term_slots(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, slot) of every term, repeats included."""
    low = K.LOWER[data]
    s, e, d = K.tokens(low, offs, K.TERM[low])
    roll = K.Rolling(low)
    docs, slots = [d], [roll.ranges(s, e)]
    for k in PREFIXES:
        long = e - s > k
        docs.append(d[long])
        slots.append(roll.ranges(s[long], s[long] + k) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return np.concatenate(docs), (np.concatenate(slots) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def present(docs: np.ndarray, ids: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, id) pairs."""
    pair = np.unique(docs * n_ids + ids)
    return pair // n_ids, pair % n_ids


@dataclass(frozen=True)
class FactorizationMachine:
    slots: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, docs: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        s = np.stack([np.bincount(docs, weights=self.v[ids, f], minlength=n) for f in range(self.v.shape[1])], 1)
        q = np.bincount(docs, weights=(self.v[ids] ** 2).sum(1), minlength=n)
        return self.bias + np.bincount(docs, weights=self.w[ids], minlength=n) + 0.5 * ((s**2).sum(1) - q)

    def index(self) -> np.ndarray:
        at = np.full(1 << SLOT_BITS, -1, np.int32)
        at[self.slots] = np.arange(len(self.slots))
        return at


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(slots: np.ndarray, texts: list[np.ndarray], y: np.ndarray, epochs: int = 30, rate: float = 0.1, decay: float = 1e-5, sparse: float = 2e-4, seed: int = 11) -> FactorizationMachine:
    """Adagrad on the logistic loss in mini-batches; w is shrunk to exact zeros by soft thresholds."""
    rng = np.random.default_rng(seed)
    k = len(slots)
    p = min(max(y.mean() if len(y) else 0.0, 1e-4), 1 - 1e-4)
    m = FactorizationMachine(slots, 0.0, np.zeros(k), rng.normal(0, 0.01, (k, RANK)))
    bias = float(np.log(p / (1 - p)))
    if not k or len(set(y.tolist())) < 2:
        return FactorizationMachine(slots, bias, np.zeros(k), np.zeros((k, RANK)))
    gw, gv, gb = np.full(k, 1e-8), np.full((k, RANK), 1e-8), 1e-8
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256)):
            ids = np.concatenate([texts[r] for r in rows]).astype(np.int64)
            docs = np.repeat(np.arange(len(rows)), [len(texts[r]) for r in rows])
            model = FactorizationMachine(slots, bias, m.w, m.v)
            err = (sigmoid(model.margins(docs, ids, len(rows))) - y[rows]) / len(rows)
            s = np.stack([np.bincount(docs, weights=m.v[ids, f], minlength=len(rows)) for f in range(RANK)], 1)
            g = np.bincount(ids, weights=err[docs], minlength=k)
            each = err[docs][:, None] * (s[docs] - m.v[ids])
            dv = np.stack([np.bincount(ids, weights=each[:, f], minlength=k) for f in range(RANK)], 1) + decay * m.v
            gw += g**2
            gv += dv**2
            gb += err.sum() ** 2
            step = rate / np.sqrt(gw)
            w = m.w - step * g
            m.w[:] = np.sign(w) * np.maximum(np.abs(w) - np.where(g != 0, step * sparse / len(rows), 0), 0)
            m.v[:] = m.v - 0.5 * rate / np.sqrt(gv) * dv
            bias -= rate / np.sqrt(gb) * err.sum()
    return FactorizationMachine(slots, bias, m.w, m.v)


def pair_gains(slots: np.ndarray, texts: list[np.ndarray], y: np.ndarray, p: np.ndarray, least: float, most: int) -> np.ndarray:
    """The slots of the pairs that gain least or more; if there are over most of these, of the best.

    The gain is half of G: of a pair's texts, how many are toxic against the sum of their chances p."""
    docs, ids = np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.concatenate([*texts, np.zeros(0, np.int32)])

    def block(k: int) -> np.ndarray:
        on = (ids >= k) & (ids < k + PAIR_BLOCK)
        x = np.zeros((len(texts), min(PAIR_BLOCK, len(slots) - k)), np.float32)
        x[docs[on], ids[on] - k] = 1
        return x

    part = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1) / np.maximum(e, 1e-9)), 0)
    gains, left, right = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(slots), PAIR_BLOCK):
        one = block(i)
        weighted = [one.T, (one * y[:, None].astype(np.float32)).T, (one * p[:, None].astype(np.float32)).T]
        for j in range(i, len(slots), PAIR_BLOCK):
            two = one if i == j else block(j)
            n, a, e = (w @ two for w in weighted)
            gain = part(a, e) + part(n - a, n - e)
            r, c = np.nonzero(gain >= least)
            off = r + i < c + j
            r, c = r[off], c[off]
            gains, left, right = np.append(gains, gain[r, c]), np.append(left, r + i), np.append(right, c + j)
            if len(gains) > most:
                top = np.lexsort((right, left, -gains.round(3)))[:most]
                gains, left, right = gains[top], left[top], right[top]
    return slots[np.union1d(left, right)]


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", max_labels: int = 20_000, max_terms: int = 8192, min_texts: int = 3, min_gain: float = 6.0) -> FactorizationMachine:
    train = training_rows(docs, labels, label, usable, max_labels)

    def slots_of(part: pa.RecordBatch) -> pa.RecordBatch:
        d, s = present(*term_slots(*K.joined(part.column("text"))), 1 << SLOT_BITS)
        y = part.column("y").to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([pa.array(y[d].astype(np.int32)), pa.array(s)], ["y", "slot"])

    sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    seen = map_text(train, slots_of, "y int, slot long").groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("a"))
    # G statistic of the 2 x 2 table of presence against label
    a, b = F.col("a"), F.col("n") - F.col("a")
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    total = float(max(n0 + n1, 1))
    rest = F.lit(total) - F.col("n")
    g = part(a, F.col("n") * n1 / total) + part(b, F.col("n") * n0 / total) + part(F.lit(n1) - a, rest * n1 / total) + part(F.lit(n0) - b, rest * n0 / total)
    seen = settle(seen.where(F.col("n") >= min_texts).select("slot", F.round(g, 6).alias("g")), "toxic-slots")
    best = seen.where(F.col("g") >= min_gain).orderBy(F.desc("g"), "slot").limit(max_terms).select("slot")
    slots = np.array(sorted(r["slot"] for r in best.collect()), np.int64)

    def rows_of(slots: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The places in slots of each text's terms, and the labels."""
        at = FactorizationMachine(slots, 0.0, np.zeros(len(slots)), np.zeros((len(slots), RANK))).index()

        def ids_of(part: pa.RecordBatch) -> pa.RecordBatch:
            d, s = term_slots(*K.joined(part.column("text")))
            i = at[s]
            d, i = present(d[i >= 0], i[i >= 0].astype(np.int64), max(len(slots), 1))
            cut = np.searchsorted(d, np.arange(part.num_rows + 1))
            return pa.RecordBatch.from_arrays([part.column("y"), pa.array([i[x:z].astype(np.int32).tobytes() for x, z in zip(cut, cut[1:])], pa.binary())], ["y", "ids"])

        rows = map_text(train, ids_of, "y int, ids binary").collect()
        rows.sort(key=lambda r: (r["ids"], r["y"]))  # the order of tasks must not matter
        return [np.frombuffer(r["ids"], np.int32) for r in rows], np.array([r["y"] for r in rows], float)

    model = fit(slots, *rows_of(slots))
    n_slots = seen.count()
    if not n1 or not n0 or n_slots < 2:
        return model
    least = min_gain + float(np.log(n_slots * (n_slots - 1) / 2))

    def chances(m: FactorizationMachine, at: np.ndarray, d: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
        i = at[s]
        return np.clip(sigmoid(m.margins(d[i >= 0], i[i >= 0].astype(np.int64), n)), 1e-4, 1 - 1e-4)

    def reach_of(part: pa.RecordBatch) -> pa.RecordBatch:
        d, s = present(*term_slots(*K.joined(part.column("text"))), 1 << SLOT_BITS)
        y = part.column("y").to_numpy(zero_copy_only=False)
        p = chances(model, model.index(), d, s, part.num_rows)
        up, down = np.where(y == 1, -np.log(p), 0.0), np.where(y == 0, -np.log(1 - p), 0.0)
        return pa.RecordBatch.from_arrays([pa.array(s), pa.array(up[d]), pa.array(down[d])], ["slot", "up", "down"])

    # sums over a slot's texts bound the gain of each of its pairs, by the log sum inequality
    reach = map_text(train, reach_of, "slot long, up double, down double").groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("up").alias("up"), F.sum("down").alias("down"))
    able = reach.where((F.col("n") >= min_texts) & (F.greatest("up", "down") >= least - 1e-6)).select("slot")
    able = np.array(sorted(r["slot"] for r in able.collect()), np.int64)
    both = np.union1d(slots, able)
    texts, y = rows_of(both)
    d = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    at = model.index()
    p = chances(model, at, d, both[np.concatenate(texts)], len(texts))
    mine = np.full(len(both), -1, np.int32)
    mine[np.searchsorted(both, able)] = np.arange(len(able))
    paired = pair_gains(able, [i[i >= 0] for i in (mine[t] for t in texts)], y, p, least, max_terms)
    final = np.union1d(slots, paired)
    if len(final) == len(slots):
        return model
    place = np.full(len(both), -1, np.int32)
    place[np.searchsorted(both, final)] = np.arange(len(final))
    return fit(final, [i[i >= 0] for i in (place[t] for t in texts)], y)


def score_documents(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted (1 if score >= threshold); columns of these names are replaced."""
    docs = without(docs, "score", "predicted")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cache: dict[str, np.ndarray] = {}

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        if "at" not in cache:
            cache["at"] = m.index()
        d, s = term_slots(*K.joined(part.column("text")))
        i = cache["at"][s]
        d, i = present(d[i >= 0], i[i >= 0].astype(np.int64), max(len(m.slots), 1))
        p = sigmoid(m.margins(d, i, part.num_rows))
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_text(docs, score, f"{kinds}, score double, predicted int")
