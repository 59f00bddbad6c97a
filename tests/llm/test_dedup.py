"""Suffix, line, MinHash and embedding dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagequarry.llm import embedding_dedup, line_dedup, minhash_dedup, suffix_dedup
from pagequarry.llm import textkernel as K

DOC = "doc_id long, text string, extra int"


def words(rng, n, kinds=4000):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


# ---- suffix dedup ----


def brute_repeats(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (doc, _), t in zip(rows, texts):
        dead = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                dead[i : i + width] = True
        edge = np.diff(np.concatenate([[0], dead.astype(int)]))
        left = bytes(b for b, d in zip(t, dead) if not d)
        out.append((doc, len(t), int(dead.sum()), int((edge == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def suffix_rows():
    rng = random.Random(3)
    passage = " ".join(words(rng, 30))
    rows = []
    for i in range(60):
        text = " ".join(words(rng, rng.randrange(5, 80)))
        if i % 3 == 0:
            text = text + " " + passage[: rng.randrange(60, len(passage))] + " " + " ".join(words(rng, 9))
        if i % 7 == 0:
            text += " " + text[: rng.randrange(20, 200)]
        rows.append((i, text))
    rows += [(100, rows[1][1]), (101, rows[1][1]), (101, rows[1][1]), (None, rows[4][1]), (102, None), (103, ""), (104, "a" * 300), (105, "é" * 90 + "ab" * 70), (106, "ab" * 70), (107, passage[:49])]
    rows += [(200 + i, f"{i} " + passage[3:103] + f" {i * 7}") for i in range(30)]
    return rows


@pytest.mark.parametrize("group", [2048, 3])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, group):
    rows = suffix_rows()
    monkeypatch.setattr(suffix_dedup, "GRAM", 16)
    df = spark.createDataFrame([(*r, 1) for r in rows], DOC)
    original = suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda d, w, text: original(d, w, 16, group, text))
    got = suffix_dedup.remove_repeats(df, width=50)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=str) == brute_repeats(rows, 50)
    kept = {r.doc_id: bytes(r.kept) for r in got.collect()}
    assert kept[102] == b"" and hashlib.sha256(kept[3]).hexdigest() in {r[4] for r in brute_repeats(rows, 50)}


@pytest.mark.parametrize("group", [2048, 2])
def test_passages_match_brute_force(spark, monkeypatch, group):
    """Words in windows of 12 words that another document has too; copies within a text don't count, repeated rows are one."""
    rng = random.Random(8)
    passage = words(rng, 40)
    rows = [(i, " ".join([*words(rng, rng.randrange(0, 30)), *passage[rng.randrange(0, 9) : rng.randrange(15, 40)], *words(rng, 5)]) if i % 2 else " ".join(words(rng, 40))) for i in range(60)]
    rows += [(100, " ".join(words(rng, 20) * 3)), (101, "the " * 60), (102, "the\n" * 14), (103, "of " * 30), (104, None), (105, ""), (106, rows[1][1]), (106, rows[1][1]), (107, " ".join(passage * 2))]
    monkeypatch.setattr(suffix_dedup, "PASSAGE_GRAM", 5)
    original = suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda d, w, g=128, **o: original(d, w, g, group, **o))
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(*r, 1) for r in rows], DOC), passage=12, texts=False)
    held = defaultdict(set)
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 11):
            held[tuple(w[k : k + 12])].add(i)
    want = []
    for i, t in rows:
        w = (t or "").split()
        want.append((i, len({k + x for k in range(len(w) - 11) if len(held[tuple(w[k : k + 12])]) > 1 for x in range(12)})))
    assert sorted((r.doc_id, r.n_passage_words) for r in got.collect()) == sorted(want)
    assert sum(n for _, n in want) > 300


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOC)).count() == 0
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOC), passage=51).columns[-1] == "n_passage_words"


def test_sliding_min():
    v = np.random.default_rng(0).integers(0, 1000, 500).astype(np.uint64)
    for w in (1, 7, 64, 500):
        assert (suffix_dedup.sliding_min(v, w) == [v[i : i + w].min() for i in range(len(v) - w + 1)]).all()


# ---- line dedup ----


def brute_lines(rows, min_words):
    docs = sorted({(d is None, d if d is not None else 0, t) for d, t in rows if t is not None}, key=lambda r: (r[0], r[1]))
    places = defaultdict(list)
    for k, (no, d, t) in enumerate(docs):
        seq = [x for x in t.split("\n") if x.split()]
        for i in range(len(seq)):
            n, j = 0, i
            while j < len(seq) and n < min_words:
                n += len(seq[j].split())
                j += 1
            if n >= min_words:
                places[tuple(seq[i:j])].append((k, i))
    dead = defaultdict(set)
    for run, at in places.items():
        for k, i in sorted(at)[1:]:
            dead[k] |= set(range(i, i + len(run)))
    out = {}
    for k, (no, d, t) in enumerate(docs):
        kept, n = [], 0
        for x in t.split("\n"):
            if x.split():
                if n not in dead[k]:
                    kept.append(x)
                n += 1
            else:
                kept.append(x)
        out[(None if no else d, t)] = ("\n".join(kept) if dead[k] else t, n, len(dead[k]))
    return [(d, *(out[(d, t)] if t is not None else (None, 0, 0))) for d, t in rows]


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(words(rng, rng.choice([1, 1, 2, 3, 25]))) for _ in range(30)]
    rows = []
    for i in range(80):
        lines = [rng.choice(pool) if rng.random() < 0.3 else " ".join(words(rng, rng.randrange(1, 9))) for _ in range(rng.randrange(0, 14))]
        if i % 4 == 0:
            k = rng.randrange(20)
            lines += pool[k : k + rng.randrange(2, 9)]
        if i % 9 == 0:
            lines.insert(len(lines) // 2, " \t")
        rows.append((i, "\n".join(lines)))
    rows += [(90, rows[8][1]), (90, rows[8][1]), (91, None), (92, ""), (93, "\n\n"), (94, "\n".join(["x y z w"] * 12)), (None, rows[12][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOC).withColumnRenamed("extra", "n_lines")
    got = line_dedup.dedup_lines(df, min_words=10)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed_lines"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_lines(rows, 10), key=str)


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOC)).count() == 0


# ---- near duplicates ----


def classes_of(n, pairs, ids):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(i)
    return {i: min(ids[j] for j in groups[find(i)]) for i in range(n)}


def test_minhash_classes_match_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(40):
        w = words(rng, 120)
        rows.append((len(rows), " ".join(w)))
        for _ in range(rng.randrange(0, 5)):
            v = list(w)
            for k in rng.sample(range(120), rng.choice([1, 2, 8, 30])):
                v[k] = "changed"
            rows.append((len(rows), "\n".join(v)))
            if rng.random() < 0.5:
                w = v  # chains drift away from their first text
    rows += [(1000, "one two"), (1001, "one  two"), (1002, None), (1003, ""), (1004, " \n"), (1005, rows[0][1]), (1005, rows[0][1])]
    got = {(r.doc_id, r.key): r for r in minhash_dedup.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], DOC)).collect()}
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    near = lambda a, b: sum((a & b).values()) >= 0.8 * sum((a | b).values()) > 0
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])]
    want = classes_of(len(rows), pairs, [d for d, _ in rows])
    assert {d: r.class_id for (d, _), r in got.items()} == {rows[i][0]: c for i, c in want.items()}
    kept = Counter(r.class_id for r in got.values() if r.kept)
    assert set(kept) == set(want.values()) and max(kept.values()) == 1


def test_minhash_keeps_one_of_each_class(spark):
    rng = random.Random(2)
    base = words(rng, 60)
    rows = [(i, " ".join([*base[:59], f"x{i}"]), 5) for i in range(700)] + [(900, "a b c", 1), (900, "a b c", 1), (901, None, 2), (902, "", 3), (903, " ".join(words(rng, 50)), 4)]
    got = minhash_dedup.keep_one(spark.createDataFrame(rows, DOC))
    assert got.columns == ["doc_id", "text", "extra"]
    assert sorted(r.doc_id for r in got.collect()) == [0, 900, 901, 902, 903]


def test_minhash_counts_beyond_16_bits(spark):
    """Of 100,000 and 70,000 times one shingle 0.70 is shared, of 200,000 shared ones and 10,000 own ones each 0.91."""
    own = [" ".join(f"{x}{i}" for i in range(10_000)) for x in "pq"]
    rows = [(0, "a " * 100_004, 1), (1, "a " * 70_004, 1), (2, "b " * 200_004 + own[0], 1), (3, "b " * 200_004 + own[1], 1)]
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2}
    h, c = np.array([1, 2, 3, 4, 2**64 - 1], np.uint64), np.array([1, 65_535, 65_536, 131_070, 1_000_000])
    assert [x.tolist() for x in minhash_dedup._unpack(minhash_dedup._pack(h, c))] == [h.tolist(), c.tolist()]
    assert [x.tolist() for x in minhash_dedup._unpack(minhash_dedup._pack(h, c * 0 + 1))] == [h.tolist(), [1] * 5]


def test_minhash_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c", 7, "x"), (2, "a b c", 8, "y"), (3, None, 9, None)]
    got = minhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, __key long, __One string"))
    assert got.columns == ["doc_id", "text", "__key", "__One"]
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


def thue_morse(rounds: int) -> tuple[str, str]:
    a, b = "a", "b"
    for _ in range(rounds):
        a, b = a + b, b + a
    return a, b


def test_hashes_tell_a_thue_morse_pair_apart(spark):
    """Polynomials modulo a power of two take these for equal, whatever their base."""
    a, b = thue_morse(12)
    assert len({*K.Rolling(np.frombuffer((a + b).encode(), np.uint8)).ranges(np.array([0, 4096]), np.array([4096, 8192])).tolist()}) == 2
    tail = " ".join(f"w{i}" for i in range(19))
    lines = spark.createDataFrame([(1, f"{a} {tail}", 0), (2, f"{b} {tail}", 0)], DOC)
    assert {r.doc_id: r.n_removed_lines for r in line_dedup.dedup_lines(lines).collect()} == {1: 0, 2: 0}
    assert {r.doc_id: r.class_size for r in minhash_dedup.near_duplicates(spark.createDataFrame([(1, a, 0), (2, b, 0)], DOC)).collect()} == {1: 1, 2: 1}
    one = spark.createDataFrame([(1, a[:1024], 0), (2, b[:1024], 0)], DOC)
    want = repeats([a[:1024].encode(), b[:1024].encode()], 400)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(one).collect()}
    assert [got[1], got[2]] == want


def repeats(texts: list[bytes], width: int) -> list[int]:
    """Bytes of each text under a string of width bytes that starts twice or more."""
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = {k for i in range(len(t) - width + 1) if seen[t[i : i + width]] > 1 for k in range(i, i + width)}
        out.append(len(gone))
    return out


def test_minhash_of_an_empty_table(spark):
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    import pyarrow as pa

    texts = []
    for _ in range(60):
        w = [f"w{i}" for i in rng.integers(0, 5000, 300)] * 2
        v = list(w)
        for i in rng.choice(600, 20, replace=False):
            v[i] = "x"
        texts += [" ".join(w), " ".join(v)]
    d, h, c, _, _ = minhash_dedup.shingles(*K.joined(pa.array(texts)))
    s = minhash_dedup.signatures(d, h, c, len(texts))
    e = np.searchsorted(d, np.arange(len(texts) + 1))
    exact = [minhash_dedup.similarity(h[e[i] : e[i + 1]], c[e[i] : e[i + 1]], h[e[i + 1] : e[i + 2]], c[e[i + 1] : e[i + 2]]) for i in range(0, len(texts), 2)]
    assert abs(np.mean(exact) - np.mean(s[::2] == s[1::2])) < 0.03


def vectors(seed=0, n=300, dim=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(25, dim))
    return (centers[rng.integers(0, 25, n)] + rng.normal(scale=0.25, size=(n, dim))).astype(np.float32)


@pytest.mark.parametrize("block", [1024, 16])
def test_embedding_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    x = vectors()
    x[40:60] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [float("inf")] + [1.0] * 15), (1005, []), (1006, x[0].tolist()[:8])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, recall=0.99999).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    want = classes_of(len(x), zip(*np.nonzero(near)), list(range(len(x))))
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    assert {i: got[i].component_id for i in want} == want
    assert all(got[i].kept == (want[i] == i) for i in want)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd)


def test_embedding_recall_of_planted_pairs(spark):
    """Of pairs just over the threshold, among 20,000 vectors, nearly all are found, and none below it."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(500, 64))
    side -= (side * x[:500]).sum(1, keepdims=True) * x[:500]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = np.where(np.arange(500) % 5 == 4, 0.899, 0.901)[:, None]
    x[10_000:10_500] = cos * x[:500] + np.sqrt(1 - cos**2) * side
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    found = [got[i] == got[10_000 + i] == (1, i) for i in range(500) if i % 5 != 4]
    assert sum(found) >= 0.99 * len(found)
    assert all(got[i] == (0, i) for i in range(500) if i % 5 == 4) and sum(n for n, _ in got.values()) == 2 * sum(found)


def test_embedding_dedup_of_an_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
