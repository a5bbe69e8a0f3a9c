import random

import numpy as np

from tiesmith.llm import shared_spans as s

SCHEMA = "doc_id bigint, text string, anchor string, key string, copy string"


def words(rng, n):
    out = []
    while sum(map(len, out)) + len(out) < n:
        out.append("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))))
    return " ".join(out)[:n]


def brute(texts, span):
    grams = {i: {t[k : k + span] for k in range(len(t) - span + 1)} for i, t in texts.items() if t}
    return {(a, b) for a in grams for b in grams if a < b and grams[a] & grams[b]}


def corpus():
    rng = random.Random(11)
    shared = [words(rng, n) for n in (199, 200, 201, 260, 700)]
    texts = {}
    for i in range(40):
        part = shared[i % 5]
        cut = rng.randrange(0, 40) if i % 3 == 0 else 0
        texts[i] = words(rng, rng.randrange(0, 400)) + "|" + part[cut:] + "|" + words(rng, rng.randrange(0, 400))
    texts |= {40: texts[3], 41: "", 42: None, 43: "x" * 1000, 44: "y" + "x" * 500, 45: "\U0001f600" * 210 + words(rng, 50), 46: "é" + "\U0001f600" * 205, 47: words(rng, 199)}
    return texts


def test_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "c", "k", "z") for i, t in texts.items()] * 2, SCHEMA)
    assert {(r.doc_id_a, r.doc_id_b) for r in s.shared_pairs(df).collect()} == brute(texts, 200)


def test_shares_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "c", "k", "z") for i, t in texts.items()], SCHEMA)
    rows = {r.doc_id: r for r in s.shared_share(df).collect()}
    assert set(rows) == {i for i, t in texts.items() if t is not None}
    for i, t in texts.items():
        if t is None:
            continue
        others = {o[k : k + 200] for j, o in texts.items() if j != i and o for k in range(len(o) - 199)}
        held = set()
        for k in range(len(t) - 199):
            if t[k : k + 200] in others:
                held.update(range(k, k + 200))
        assert rows[i].shared_chars == len(held), i
        assert rows[i].n_chars == len(t)


def test_shares_of_a_passage_in_many_records(spark, monkeypatch):
    monkeypatch.setattr(s, "BROADCAST_KEYS", 0)
    rng = random.Random(5)
    hot, other = words(rng, 320), words(rng, 260)
    texts = {k: words(rng, rng.randrange(0, 60)) + hot[k % 7 :] + words(rng, rng.randrange(0, 60)) + (other[: 190 + k] if k % 4 == 0 else "") for k in range(60)}
    texts |= {100 + k: words(rng, 40) + hot[k : k + 200 + 3 * k] + words(rng, 40) for k in range(40)}
    rows = {r.doc_id: r.shared_chars for r in s.shared_share(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    for i, t in texts.items():
        others = {o[k : k + 200] for j, o in texts.items() if j != i for k in range(len(o) - 199)}
        assert rows[i] == len({c for k in range(len(t) - 199) if t[k : k + 200] in others for c in range(k, k + 200)})


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert s.shared_pairs(empty).count() == 0
    assert s.shared_share(empty).count() == 0
    long = words(random.Random(1), 300_000)
    df = spark.createDataFrame([(1, long), (2, "q" + long[150_000:150_200]), (None, long), (3, "short")], "doc_id bigint, text string")
    assert [(r.doc_id_a, r.doc_id_b) for r in s.shared_pairs(df).collect()] == [(1, 2)]


def test_keys_beyond_the_broadcast_bound_give_the_same(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    monkeypatch.setattr(s, "BROADCAST_KEYS", 0)
    assert {(r.doc_id_a, r.doc_id_b) for r in s.shared_pairs(df).collect()} == brute(texts, 200)


def test_winnowing_keeps_an_anchor_of_every_run():
    rng = random.Random(2)
    rolling = s.Rolling(30)
    for _ in range(30):
        run = words(rng, 50)
        a, b = words(rng, rng.randrange(0, 90)) + run, run + words(rng, rng.randrange(0, 90))
        assert set(s.anchors(a, 50, 30, rolling)) & set(s.anchors(b, 50, 30, rolling))


def test_window_least():
    values = np.array(random.Random(4).sample(range(1000), 300), np.uint64)
    assert s.window_least(values, 7).tolist() == [min(values[k : k + 7]) for k in range(294)]


def test_stock_phrases_give_way_to_longer_anchors(spark, monkeypatch):
    rng = random.Random(7)
    stock, long = words(rng, 170), words(rng, 230)
    texts = {k: words(rng, rng.randrange(0, 120)) + "#" + (long if k % 9 == 0 else stock) + "#" + words(rng, rng.randrange(0, 120)) for k in range(60)}
    texts |= {k: words(rng, 90) + stock[: 100 + k] + words(rng, 90) for k in range(60, 70)} | {70: stock + long, 71: texts[5]}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    monkeypatch.setattr(s, "HOT", 4)
    candidates = s._candidates(df, 200, 130)
    assert all(r.a < r.b for r in candidates.collect())
    assert {(r.doc_id_a, r.doc_id_b) for r in s.shared_pairs(df).collect()} == brute(texts, 200)
    assert candidates.count() < 60
