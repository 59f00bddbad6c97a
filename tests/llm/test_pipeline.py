"""The pipeline's stages: columns, decisions, and a brute-force check of each one's effect."""

import random
from collections import Counter

import corpus_pipeline as P
from pagequarry.llm import bpe
from tests.llm.test_dedup import brute_lines, classes_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines int"


def corpus(spark, folder):
    rng = random.Random(9)
    passage = "\n".join(" ".join(rng.choice("alpha beta gamma delta epsilon".split()) + str(rng.randrange(99)) for _ in range(15)) + "." for _ in range(4))
    rows, labels = [], []
    for i in range(240):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(60)]
        text = ". ".join(" ".join(words[k : k + 12]).capitalize() for k in range(0, 60, 12)) + "."
        bad = i % 6 == 0
        if bad:
            text = " ".join(w.upper() + "!!" for w in words)
        if i % 10 == 1:
            text += "\n" + passage
        rows.append((i, text, "en", f"s{i % 4}", len(text), 1))
        labels.append((i, int(not bad), 0))
    rows += [(300 + i, " ".join(rows[2][1].split()[:-1] + [f"end{i}."]), "en", "s0", 1, 1) for i in range(5)]
    rows += [(400, rows[3][1], "en", "s1", 1, 1), (401, None, None, None, None, None), (402, "", "en", None, 0, 1), (5, *rows[5][1:])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return passage


def brute_near(rows):
    """Classes of rows with five-word shingles 0.8 alike or more, by comparing all pairs."""
    sets = []
    for r in rows:
        w = (r.text or "").split()
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    near = lambda a, b: sum((a & b).values()) >= 0.8 * sum((a | b).values()) > 0
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])]
    return classes_of(len(rows), pairs, list(range(len(rows))))


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    passage = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near_duplicates", "mix", "tokens"]
    kept = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs.collect()
    ids = {n: Counter(r.doc_id for r in rows) for n, rows in kept.items()}
    assert not any(i is not None and i < 240 and i % 6 == 0 for i in ids["quality"])
    assert sum(i is not None and i < 240 and i % 6 != 0 for i in ids["quality"]) >= 195
    assert sum(passage in (r.text or "") for r in kept["lines"]) == 1
    assert 400 not in ids["lines"]
    # lines: every text is what brute force leaves of it; a text that was all copies is gone
    before = sorted(kept["quality"], key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    cut = brute_lines([(r.doc_id, r.text) for r in before], 20)
    assert Counter((r.doc_id, r.text) for r in kept["lines"]) == Counter((d, t) for d, t, n, gone in cut if not gone or gone < n)
    # near duplicates: one document of each class, and that class whole
    rows = kept["lines"]
    classes = brute_near(rows)
    left = Counter((r.doc_id, r.text) for r in kept["near_duplicates"])
    members = {}
    for i, r in enumerate(rows):
        members.setdefault(classes.get(i, i), []).append((r.doc_id, r.text))
    assert len(kept["near_duplicates"]) == len(members) and all(sum(left[m] for m in set(ms)) == 1 for ms in members.values())
    assert sum(ids["near_duplicates"][i] for i in [2, *range(300, 305)]) == 1 and ids["near_duplicates"][5] == 1
    copies = {r.doc_id: n for r in kept["near_duplicates"] for n in [ids["mix"][r.doc_id]]}
    assert max(copies.values()) <= 3 and len(kept["mix"]) > 0
    # mix: each source's words are within one document of its target
    words = lambda r: len((r.text or "").split())
    sizes, got, largest = Counter(), Counter(), Counter()
    for r in kept["near_duplicates"]:
        sizes[r.source] += words(r)
        got[r.source] += words(r) * ids["mix"][r.doc_id]
        largest[r.source] = max(largest[r.source], words(r))
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    for name, target in zip(order, P.mixing.targets([sizes[x] for x in order], [1 + i % 3 for i in range(len(order))])):
        assert abs(got[name] - target) <= largest[name]
    tokens = P.STAGES[-1][1](spark, docs, folder).collect()
    codec = bpe.Codec(*bpe.default_vocabulary())
    want = Counter((r.doc_id, *codec.digests(codec.encode(r.text or ""))) for r in kept["mix"])
    assert Counter(map(tuple, tokens)) == want
    assert Counter(map(tuple, P.run(spark, folder).collect())) == want


def test_stages_on_no_rows(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for _, stage in P.STAGES:
        assert stage(spark, docs, folder).count() == 0
