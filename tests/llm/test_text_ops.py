"""Quality rules, classifiers, mixing, WARC and BPE against brute force, round trips and held-out labels."""

import base64
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import bpe, mixing, quality_classifier, quality_rules, queries, toxicity, warc

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "word", "a b c d e f g h " * 12, "é ü ß\x0bx\x1cy\r\nz\n\nz\r", "# * $ % & | < >", "x\n" * 30, "Same line of words here.\n" * 9, "日本語。 テキスト。\n" * 12]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", "keep") for i, t in enumerate(texts)] + [(None, "no id", None, None, "keep"), (0, texts[0], "en", "s0", "keep")], "doc_id long, text string, lang string, source string, kept string")


# ---- quality rules ----


def base_counts(t):
    t = t or ""
    words = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    hit = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_base_counts_match_brute_force(spark):
    rng = random.Random(1)
    texts = ODD + ["\n".join(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    df = documents(spark, texts)
    got = quality_rules.clean_documents(df)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept", "clean_text"]
    for r in got.collect():
        want = base_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
        assert (r.clean_text is None) == (r.text is None)


def test_line_rules(spark):
    rng = random.Random(3)
    good = "\n".join("In" + "".join(f" {rng.choice('abcdefgh')}word{rng.randrange(999)}" for _ in range(12)) + "." for i in range(6))
    bad = {"symbols": "no%%% more*** of### this&&& here$$$ now%%%.\n" * 9, "shout": "\n".join(f"BUY!! THIS!! THING!! NUMBER!! {i}!!" for i in range(9)), "nav": "\n".join(f"Home | About | Page {i} | Contact |" for i in range(9)), "open": "\n".join(f"no full stop in line {i}" for i in range(9))}
    texts = [good, *bad.values(), good + "\nHome | News | More |"]
    rows = {r.text: r for r in quality_rules.clean_documents(documents(spark, texts)).collect()}
    assert rows[good].kept and rows[good].clean_text == good
    assert not any(rows[t].kept for t in bad.values())
    assert rows[texts[-1]].kept and rows[texts[-1]].clean_text == good


@pytest.mark.parametrize("pad", ["", " " * 4, " " * 5, "\t" * 9, " \r" * 40, " " * 3000])
def test_padded_lines_end_as_sentences(spark, pad):
    rng = random.Random(8)
    lines = ["In" + "".join(f" {rng.choice('abcdefgh')}word{rng.randrange(999)}" for _ in range(12)) + end for end in (".", "?", "。", "”", ".")]
    text = "\n".join(x + pad for x in [*lines, "no full stop here"])
    rows = [r for r in quality_rules.clean_documents(documents(spark, [text, "", pad])).collect() if r.text == text]
    assert rows and all(r.kept and r.n_lost_words == 4 and r.clean_text == "\n".join(x + pad for x in lines) for r in rows)


def test_quality_rules_on_labels(spark):
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    got = queries.op2_quality_rules(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").groupBy("quality", "base_failed", "kept").count().collect()
    n = Counter({(r.quality, r.kept): 0 for r in got})
    for r in got:
        if not r.base_failed:
            n[r.quality, r.kept] += r["count"]
    assert n[1, True] >= 0.97 * (n[1, True] + n[1, False]) and n[0, False] >= 0.97 * (n[0, True] + n[0, False])


# ---- classifiers ----


def held_out_accuracy(spark, query, label, threshold):
    scored = query(spark, DATA)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold)
    out = [r for r in rows if r.held_out]
    return np.mean([r.predicted == r[label] for r in out])


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_quality_classifier_on_held_out_labels(spark):
    assert held_out_accuracy(spark, queries.op6_quality_classifier, "quality", 0.7) >= 0.95


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_toxicity_on_held_out_labels(spark):
    assert held_out_accuracy(spark, queries.op8_toxicity, "toxic", 0.3) >= 0.9


@pytest.mark.parametrize("module,label", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_rows(spark, module, label):
    from pyspark.sql import functions as F

    df = documents(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = module.learn(df, none, F.lit(True), label)
    assert all(0 <= r.score <= 1 for r in module.score_documents(df, model).collect())
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    model = module.learn(df, some, F.lit(True), label)
    assert module.score_documents(df, model).count() == len(ODD) + 2
    empty = df.limit(0)
    assert module.score_documents(empty, module.learn(empty, none, F.lit(True), label)).count() == 0


def test_ranking_learns_an_order():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, quality_classifier.N_FEATURES))
    x[:, 3] -= 3 * (y == 0)
    m = quality_classifier.fit_pairs(x, y)
    assert ((m.score(x, 0.7) >= 0.7) == y).mean() > 0.9


def test_factorization_machine_learns_a_pair():
    """Label 1 needs both terms: no sum of single weights separates it as well."""
    rng = np.random.default_rng(1)
    texts = [np.flatnonzero(rng.random(6) < 0.5).astype(np.int32) for _ in range(1500)]
    y = np.array([float((0 in t) == (1 in t)) for t in texts])
    m = toxicity.fit(np.arange(6), texts, y, epochs=60)
    docs = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    p = m.margins(docs, np.concatenate(texts).astype(np.int64), len(texts)) > 0
    assert (p == y).mean() > 0.95


@pytest.mark.parametrize("flip", [0, 1])
def test_toxicity_learns_a_pair_of_neutral_words(spark, flip):
    """Neither word says anything about the label alone; learn() has to find the two among others."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = []
    for i in range(3000):
        one, two = rng.random() < 0.5, rng.random() < 0.5
        text = [f"noise{rng.randrange(300):03d}" for _ in range(20)] + ["zebrafolk"] * one + ["quince"] * two
        rows.append((i, " ".join(rng.sample(text, len(text))), int(one == two) ^ flip))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.col("doc_id") < 2000)
    out = toxicity.score_documents(df.where("doc_id >= 2000"), model, 0.5).collect()
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.95


# ---- mixing ----


def brute_targets(sizes, weights):
    total, t = sum(sizes), [sum(sizes) * w / sum(weights) for w in weights]
    capped = [False] * len(sizes)
    while True:
        over = [i for i in range(len(t)) if not capped[i] and t[i] > 3 * sizes[i] + 1e-9]
        if not over:
            return t
        for i in over:
            capped[i] = True
        rest = total - sum(3 * sizes[i] for i in range(len(t)) if capped[i])
        free = sum(weights[i] for i in range(len(t)) if not capped[i])
        t = [3 * sizes[i] if capped[i] else rest * weights[i] / free for i in range(len(t))]


def test_targets():
    for sizes in ([10, 20, 30], [1, 1000, 5], [0, 7, 9, 1, 400], [5], [0, 0]):
        w = [mixing.CYCLE[i % 3] for i in range(len(sizes))]
        assert np.allclose(mixing.targets(sizes, w), brute_targets(sizes, w) if sum(sizes) else [0] * len(sizes))


@pytest.mark.parametrize("block", [64, 7])
def test_mix_meets_its_targets(spark, block):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randrange(0, 300)).strip(), rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", "only"), (None, "x y", "b"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix_documents(df, block).collect()
    assert sorted(map(tuple, mixing.mix_documents(df.repartition(3), block).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, brute_targets([sizes[s] for s in names], [mixing.CYCLE[i % 3] for i in range(len(names))])))
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    spread = [r.taken / r["size"] for r in got if r.source == "a" and r["size"]]
    assert {round(x) for x in spread} <= {int(np.floor(want["a"] / sizes["a"])), int(np.ceil(want["a"] / sizes["a"]))}


def test_mix_of_an_empty_table(spark):
    assert mixing.mix_documents(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_schedule_is_evenly_spread(spark):
    p = mixing.Plan(["a", "b", "c"], np.array([64000] * 3), np.array([32000.0, 64000.0, 96000.0]), 64)
    rows = sorted(mixing.schedule(spark.range(1), p).select("slot", "s", "rank").collect())
    seen = [0, 0, 0]
    for i, r in enumerate(rows[:2900], 1):
        assert r["rank"] == seen[r.s]
        seen[r.s] += 1
        assert all(abs(seen[s] - i * (s + 1) / 6) < 12 for s in range(3))


# ---- WARC ----


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, tmp_path, compress):
    html = ["<p>one</p>", None, "", "two\r\n\r\nWARC/1.1\r\n", "é" * 5000, "<p>one</p>", "three", "<p>one</p>"]
    rows = [(i, f"https://e.org/{i}" if i % 2 else None, h, 7) for i, h in enumerate(html)] + [(None, "https://e.org/n", "alone", 7), (20, "u", "same", 7), (20, "u", "same", 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    uri = f"file://{tmp_path}/w"
    files = warc.write_pages(df, uri, roll=300, compress=compress)
    got = warc.read_archives(files, uri).collect()
    assert {r.kind for r in got} == {"record"} and len(got) == len(rows)
    by = {warc.page_of(r.record_id): r for r in got}
    for page, _, h, _ in rows:
        raw, r = (h or "").encode(), by[page]
        peers = [p for p, _, x, _ in rows if (x or "").encode() == raw and p is not None]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), sha(raw))
        assert (r.record_type, warc.page_of(r.refers_to)) == (("response", None) if page is None or page == max(peers) else ("revisit", max(peers)))
        assert bytes(r.payload) == (raw if r.record_type == "response" else b"")
    trip = warc.roundtrip(df)
    assert trip.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and trip.count() == len(rows)


@pytest.mark.parametrize("compress", [True, False])
def test_warc_of_odd_urls(spark, tmp_path, compress):
    urls = ["https://e.org/\x01a", "https://e.org/a b\tc\r\nWARC-Type: x", "", "https://e.org/" + "q" * 3_000_000, "https://e.org/\u2028é", "https://e.org/\x7f%20"]
    df = spark.createDataFrame([(i, u, "same" if i < 2 else f"p{i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {warc.page_of(r.record_id): r for r in warc.read_archives(warc.write_pages(df, f"file://{tmp_path}/w", compress=compress), f"file://{tmp_path}/w").collect()}
    want = ["https://e.org/%01a", "https://e.org/a%20b%09c%0D%0AWARC-Type:%20x", None, urls[3], "https://e.org/%E2%80%A8é", "https://e.org/%7F%20"]
    assert [got[i].target for i in range(6)] == want and got[0].record_type == "revisit"
    assert {r.page_id: r.target for r in warc.roundtrip(df).collect()} == dict(enumerate(want))


def test_salvage_of_members_with_several_records():
    recs = [warc.render(i, None, b"x" * i, warc.digest32(b"x" * i)) for i in range(9)]
    damaged = recs[4].replace(b"xxxx", b"xxyx")
    data = warc.member(b"".join(recs[:3])) + warc.member(recs[3] + damaged + recs[5]) + warc.member(b"".join(recs[6:]))
    out = list(warc.salvage(io.BytesIO(data)))
    assert [warc.page_of(x[3]["id"]) for x in out if x[0] == "record"] == [0, 1, 2, 3, 5, 6, 7, 8]
    gaps = [x for x in out if x[0] == "gap"]
    assert len(gaps) == 1 and f"bytes {len(recs[3])} to {len(recs[3] + damaged)}" in gaps[0][3] and "payload digest" in gaps[0][3]


def test_salvage_of_a_header_block_beyond_16_mib():
    rec = warc.render(1, "https://e.org/" + "q" * (17 << 20), b"p", warc.digest32(b"p"))
    for data in (rec + warc.render(2, None, b"z", warc.digest32(b"z")), warc.member(rec, 1)):
        out = list(warc.salvage(io.BytesIO(data)))
        assert {x[0] for x in out} == {"record"} and warc.page_of(out[0][3]["id"]) == 1


def test_warc_of_an_empty_table(spark):
    assert warc.roundtrip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_finds_what_damage_left(compress):
    recs = [warc.render(i, "https://e.org/", f"payload {i} ".encode() * 50, warc.digest32(f"payload {i} ".encode() * 50)) for i in range(8)]
    parts = [warc.member(r) if compress else r for r in recs]
    starts = np.cumsum([0, *map(len, parts)])
    data = bytearray(b"".join(parts))
    data[starts[2] + 60 : starts[2] + 90] = b"\x00" * 30
    data[starts[5] : starts[5] + 4] = b"junk"
    data = bytes(data[: starts[8] - 25])
    out = list(warc.salvage(io.BytesIO(data)))
    got = [warc.page_of(x[3]["id"]) for x in out if x[0] == "record"]
    assert got == [0, 1, 3, 4, 6]
    gaps = [x[1:3] for x in out if x[0] == "gap"]
    assert gaps == [(starts[2], starts[3]), (starts[5], starts[6]), (starts[7], len(data))]
    assert [x[1] for x in out][1:] == [x[2] for x in out][:-1] and out[0][1] == 0 and out[-1][2] == len(data)
    assert list(warc.salvage(io.BytesIO(b""))) == [] and [x[0] for x in warc.salvage(io.BytesIO(b"no archive"))] == ["gap"]


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("other", [b"", b"\x1f\x8b\x08", b"WARC/1."])
def test_salvage_of_a_large_archive_with_a_damaged_first_record(compress, other):
    rng = random.Random(6)
    recs = []
    for i in range(40):
        payload = rng.randbytes(150_000).hex().encode()
        recs.append(warc.render(i, "https://e.org/", payload, warc.digest32(payload)))
    parts = [warc.member(r) if compress else r for r in recs]
    data = bytearray(b"".join(parts))
    data[0:4] = b"junk"
    data[100 : 100 + len(other)] = other  # a start that isn't one, of either kind
    assert len(data) > 5 << 20
    out = list(warc.salvage(io.BytesIO(bytes(data))))
    assert [x[:3] for x in out if x[0] == "gap"] == [("gap", 0, len(parts[0]))]
    assert [warc.page_of(x[3]["id"]) for x in out if x[0] == "record"] == list(range(1, 40))
    assert [x[1] for x in out][1:] == [x[2] for x in out][:-1] and out[-1][2] == len(data)


# ---- BPE ----


def long_texts():
    rng = random.Random(4)
    words = ["the", "Haus", "été", "12345", "don't", "x" * 40, "  ", "\n\n", "日本", "!?", "we'll", " "]
    return [" ".join(rng.choice(words) for _ in range(900)), "a" * 3000, " " * 2500 + "x" * 300 + "\t" * 700, "é" * 1500, "".join(rng.choice(words) for _ in range(600)), "x " * 1000 + " " * 600 + "y " * 500]


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 10), (200, 40), (64, 8)])
def test_bpe_matches_tiktoken(spark, chunk, overlap):
    ranks, pattern = bpe.default_vocabulary()
    codec = bpe.Codec(ranks, pattern)
    texts = ODD + long_texts() + ["<|endoftext|> is text"]
    df = documents(spark, texts)
    got = bpe.encode_documents(df, ranks, pattern, output="digest", chunk=chunk, overlap=overlap).collect()
    want = []
    for r in df.collect():
        t = r.text or ""
        ids = codec.encode(t)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_bpe_ids_decode(spark):
    ranks, pattern = bpe.default_vocabulary()
    df = documents(spark, ODD + long_texts()[:2])
    out = bpe.decode_documents(bpe.encode_documents(df, ranks, pattern, chunk=500, overlap=50), ranks, pattern).collect()
    assert Counter(bytes(r.decoded or b"") for r in out) == Counter((r.text or "").encode() for r in df.collect())
    assert bpe.encode_documents(df.limit(0), ranks, pattern).count() == 0


def test_training_rows_are_bounded_by_documents(spark):
    """3,000 rows of one doc_id are one document; the least text of them is learned from."""
    docs = spark.createDataFrame([(1, f"text {i:04d}") for i in range(3000)] + [(2, None), (3, "c"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    rows = quality_classifier.training_rows(docs, labels, "quality", F.lit(True), 10).collect()
    assert sorted(((r.text, r.y) for r in rows), key=str) == [("c", 0), ("text 0000", 1), (None, 0)]
    assert quality_classifier.training_rows(docs, labels, "quality", F.lit(True), 2).count() == 2


def test_prefix_sums_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPAN", 3)
    rows = [(s, k, (k * 7 + s) % 5) for s in range(3) for k in range(20) if (k + s) % 4]
    got = {(r.s, r.at): r.before for r in mixing.before(spark.createDataFrame(rows, "s int, at long, n long"), "at", "n").collect()}
    assert got == {(s, k): sum(n for s2, k2, n in rows if s2 == s and k2 < k) for s, k, _ in rows}


def test_scores_match_the_dense_formulas():
    """Both models' scores against their formulas written out, pair by pair."""
    rng = np.random.default_rng(5)
    m = toxicity.FactorizationMachine(np.arange(6) * 10, -0.7, rng.normal(size=6), rng.normal(size=(6, toxicity.RANK)))
    sets = [[0, 2, 5], [], [1], [0, 1, 2, 3, 4, 5]]
    docs, ids = np.repeat(np.arange(4), [len(x) for x in sets]), np.concatenate([np.array(x, int) for x in sets])
    want = [m.bias + sum(m.w[i] for i in x) + sum(float(m.v[i] @ m.v[j]) for k, i in enumerate(x) for j in x[k + 1 :]) for x in sets]
    assert np.allclose(m.margins(docs, ids, 4), want)
    x = rng.normal(size=(7, 4))
    r = quality_classifier.PairwiseRanker(x.mean(0), x.std(0), rng.normal(size=4), 0.3, 1.7)
    raw = [sum(w * min(max((a - mu) / sd, -8), 8) for a, mu, sd, w in zip(row, r.mean, r.scale, r.weights)) for row in x]
    assert np.allclose(r.score(x, 0.7), [1 / (1 + np.exp(-((z - 0.3) * 1.7 + np.log(0.7 / 0.3)))) for z in raw])


def test_many_sources_are_mixed_alike(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, None if i % 11 == 0 else f"s{(i * i) % 17}é", " ".join(["w"] * rng.randrange(0, 90))) for i in range(300)] + [(1000, "z", "w " * 4000), (1001, "empty", None), (1001, "empty", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    usual = sorted(map(tuple, mixing.mix_documents(df).collect()), key=str)
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    many = sorted(map(tuple, mixing.mix_documents(df).collect()), key=str)
    assert [(*a[:5], a[6]) for a in many] == [(*a[:5], a[6]) for a in usual] and np.allclose([a[5] for a in many], [a[5] for a in usual])
    assert sum(a[6] for a in many) > 0 and mixing.mix_documents(df.where("false")).count() == 0


def test_very_long_texts_are_scored_whole(spark):
    """What a text of 4 MB says at its end counts as at its start."""
    rng = random.Random(3)
    plain = " ".join(f"w{rng.randrange(300)}" for _ in range(800_000))
    m = toxicity.FactorizationMachine(np.sort(toxicity.term_slots(*toxicity.K.joined(toxicity.pa.array(["grob"])))[1]), -3.0, np.array([6.0]), np.zeros((1, toxicity.RANK)))
    docs = spark.createDataFrame([(1, plain), (2, plain + " Grob!"), (3, "grob " + plain), (4, None)], "doc_id long, text string")
    got = {r.doc_id: round(r.score, 4) for r in toxicity.score_documents(docs, m).collect()}
    assert got == {1: 0.0474, 2: 0.9526, 3: 0.9526, 4: 0.0474}
