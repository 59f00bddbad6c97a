"""Quality classifier: Bradley-Terry scores from preference pairs (a good text over a bad one).

The loss is logistic on the difference of two texts' features, so only the order of scores is
learned; the cut-off is the quantile of the scores that leaves as large a share of texts below
it as the labels call bad. Features are shares and ratios of a text's own bytes and words.
Labels, language, source and id are never features.

Training uses at most ``max_labels`` labelled documents (those with the smallest hash of their id),
one text each, which bounds the driver's work; every text is then scored by one narrow pass without a
shuffle. The cut comes from the labelled sample too: the share of bad labels says something of texts
that are drawn as those were, and nothing of a corpus that is made up otherwise.

Null and empty texts get the score of their (zero) features. Without two classes the score is 0.5. Of rows
that share a doc_id the least text is learned from, of labels that share one the least label; all such rows
are scored. Rows with a null doc_id are never learned from. Equal scores get equal verdicts. A column
score or predicted of the input, in whatever case, is replaced."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm import textkernel as K
from pagequarry.llm.common import discard, map_text, settle, without

_PUNCT = K.table(b",.;:'\"()-")
_DIGIT = K.table(b"0123456789")
_UPPER = K.table(bytes(range(65, 91)))
_ALPHA = K.table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_MARKS = K.table(b"#*$%&<>@^~=+_\\{}[]/")
N_FEATURES = 16


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, N_FEATURES), each about 0 to 1."""
    n = len(offs) - 1
    ws, we, wd = K.words(data, offs)
    roll = K.Rolling(data)
    wh = roll.ranges(ws, we)
    nw = np.bincount(wd, minlength=n)
    w1 = np.maximum(nw, 1)
    size = np.maximum(offs[1:] - offs[:-1], 1)
    alpha = K.per_text(_ALPHA[data], offs)
    count = lambda t: K.per_text(t[data], offs)
    _, later = K.repeated(K.within(wh, wd))
    starts = K.window_starts(wd, 3)
    t3, _ = K.repeated(K.within(K.Rolling(wh).windows(3)[starts], wd[starts]))
    stutter = np.zeros(len(wh), bool)
    stutter[1:] = (wh[1:] == wh[:-1]) & (wd[1:] == wd[:-1])
    ls, le, ld = K.lines(data, offs)
    full = le > ls
    _, dup = K.repeated(K.within(roll.ranges(ls[full], le[full]), ld[full]))
    nl = np.maximum(np.bincount(ld[full], minlength=n), 1)
    unended = full & ~K.table(b".!?:\"')")[data[np.maximum(le - 1, 0)]] if len(data) else full
    marked = _MARKS[data[we - 1]] if len(we) else np.zeros(0, bool)
    odd = np.bincount(wd[marked], minlength=n)
    out = np.stack([
        K.per_text(_UPPER[data], offs) / np.maximum(alpha, 1), np.minimum(1, count(K.table(b"!")) / w1), np.minimum(1, count(K.table(b"|")) / w1), np.minimum(1, count(_MARKS) / w1),
        odd / w1, count(_DIGIT) / size, count(_PUNCT) / size * 5, alpha / size,
        np.bincount(wd[later], minlength=n) / w1, np.bincount(wd[starts[t3]], minlength=n) / w1, np.bincount(wd[stutter], minlength=n) / w1, np.bincount(ld[full][dup], minlength=n) / nl,
        np.bincount(ld[unended], minlength=n) / nl, np.minimum(1, (alpha / w1) / 12), np.minimum(1, np.log1p(nw) / 10), (nw < 20) * 1.0,
    ], axis=1)
    return out


@dataclass(frozen=True)
class PairwiseRanker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    #: Score below which a text is rejected, and how fast the reported score moves about it.
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray, at_cut: float) -> np.ndarray:
        """0 to 1; at_cut at the cut-off."""
        z = (self.raw(x) - self.cut) * self.slope + np.log(at_cut / (1 - at_cut))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 200_000, steps: int = 400, rate: float = 0.5, decay: float = 1e-4, seed: int = 7) -> PairwiseRanker:
    """Weights by gradient descent on log(1 + exp(-(score of the better - score of the worse)))."""
    mean, scale = x.mean(0) if len(x) else np.zeros(N_FEATURES), (x.std(0) if len(x) else np.ones(N_FEATURES))
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1] if len(x) else N_FEATURES)
    if not len(good) or not len(bad):
        return PairwiseRanker(mean, scale, w, 0.0, 0.0)
    rng = np.random.default_rng(seed)
    z = np.clip((x - mean) / scale, -8, 8)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    speed = np.zeros_like(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -50, 50)))
        grad = -(diff * p[:, None]).mean(0) + decay * w
        speed = 0.9 * speed + grad
        w = w - rate * speed * 0.1
    s = z @ w
    # the quantile at the share of bad labels, in the middle of the gap between its neighbours
    order = np.sort(s)
    k = len(bad)
    cut = (order[k - 1] + order[min(k, len(order) - 1)]) / 2
    spread = max(np.subtract(*np.percentile(s, [75, 25])), 1e-6)
    return PairwiseRanker(mean, scale, w, float(cut), float(2.0 / spread))


def bounded_labels(labels: DataFrame, label: str, usable: Column, max_labels: int) -> DataFrame:
    """(doc_id, y) of at most max_labels labelled rows, chosen by hash of the id."""
    rows = labels.where(usable & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_labels: int) -> DataFrame:
    """(text, y) of at most max_labels labelled documents, written down: one row a doc_id, its least text."""
    chosen = bounded_labels(labels, label, usable, max_labels)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    return settle(rows.select("text", "y"), f"train-{label}")


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", max_labels: int = 20_000) -> PairwiseRanker:
    def take(part: pa.RecordBatch) -> pa.RecordBatch:
        x = features(*K.joined(part.column("text")))
        return pa.RecordBatch.from_arrays([part.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])

    train = training_rows(docs, labels, label, usable, max_labels)
    rows = map_text(train, take, "y int, x binary").collect()
    discard(train)
    rows.sort(key=lambda r: (r["x"], r["y"]))  # the order of tasks must not matter
    x = np.stack([np.frombuffer(r["x"]) for r in rows]) if rows else np.zeros((0, N_FEATURES))
    return fit_pairs(x, np.array([r["y"] for r in rows], int))


def score_documents(docs: DataFrame, model: PairwiseRanker, threshold: float = 0.7) -> DataFrame:
    """docs with score and predicted (1 if score >= threshold); columns of these names are replaced."""
    docs = without(docs, "score", "predicted")
    names = docs.columns

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(features(*K.joined(part.column("text"))), threshold)
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_text(docs, score, f"{kinds}, score double, predicted int")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
