import random
import re
import unicodedata

import numpy as np
import pytest

from tiesmith.llm import clusters as c


def words(t):
    t = "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))
    return frozenset(re.findall(r"[^\W_]+", t.casefold()))


def brute(rows, share):
    texts = {}
    for k, t in rows:
        if k is not None and t is not None:
            texts.setdefault(k, t)
    sets = {k: words(t) for k, t in texts.items()}
    similar = lambda a, b: len(a & b) >= share * len(a | b)
    return {(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])}


def corpus(n=260):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    bases = [rng.sample(vocabulary, 18) for _ in range(30)]
    rows = []
    for k in range(n):
        held = list(rng.choice(bases)) if rng.random() < 0.7 else rng.sample(vocabulary, 16)
        for _ in range(rng.randrange(0, 6)):
            held[rng.randrange(len(held))] = rng.choice(vocabulary)
        rng.shuffle(held)
        rows.append((f"s{k:03}", " ".join(held)))
    return rows + [("t1", rows[0][1].upper() + "!"), ("t2", "é w1 w2"), ("t3", "E, w2 w1."), ("t4", ""), ("t5", "--"), ("t6", None), (None, "w1"), ("t7", "long " + "w5 " * 50_000)]


SCHEMA = "sentence_id string, masked string, point string, words int, cluster int"


@pytest.mark.parametrize("k", [None, 12])
def test_recall_against_brute_force(spark, k):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows] * 2, SCHEMA)
    got = [(r.key_a, r.key_b) for r in c.similar_pairs(df, "sentence_id", "masked", k=k).collect()]
    true = brute(rows, 0.6)
    assert len(got) == len(set(got)) and set(got) <= true
    assert len(set(got)) >= 0.98 * len(true)


def test_hot_clusters_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 16)
    rows = corpus(200)
    df = spark.createDataFrame(rows, "sentence_id string, masked string")
    points = c.fit(c.word_sets(df, "sentence_id", "masked"), 1).assign(4)
    assert points.count() == len({words(t) for k, t in rows if k and t is not None})
    one = c.similar_points(points, 0.6, block=10_000).collect()
    many = c.similar_points(points, 0.6, block=16).collect()
    assert sorted((min(r), max(r)) for r in one) == sorted((min(r), max(r)) for r in many)
    assert len({(min(r), max(r)) for r in one}) == len(one)


def test_large_clusters_are_divided(spark, monkeypatch):
    for name, value in (("PART", 20), ("COPIES", 3)):
        monkeypatch.setattr(c, name, value)
    rows = corpus(400)
    df = spark.createDataFrame(rows, "sentence_id string, masked string")
    model = c.fit(c.word_sets(df, "sentence_id", "masked"), 6)
    points = model.assign(2)
    whole = {tuple(r) for r in c.similar_points(points).collect()}
    divided = [tuple(r) for r in c.similar_points(points, model=model, split=50).collect()]
    assert len(divided) == len(set(divided)) and set(divided) <= whole and len(divided) >= 0.97 * len(whole)


def windows(n):
    """Windows over one row of words: each is similar to the five on either side and to no other."""
    return [(f"s{k:04}", " ".join(f"w{k + j}" for j in range(20))) for k in range(n)]


def test_large_clusters_lose_no_pair(spark, monkeypatch):
    for name, value in (("PART", 1), ("COPIES", 3)):
        monkeypatch.setattr(c, name, value)
    df = spark.createDataFrame(windows(200), "sentence_id string, masked string")
    model = c.fit(c.word_sets(df, "sentence_id", "masked"), 1)
    points = model.assign(2)
    got = [tuple(r) for r in c.similar_points(points, model=model, split=50).collect()]
    assert len(got) == len(set(got)) == sum(200 - shift for shift in range(1, 6))


def test_pairs_without_a_common_cluster_are_found(spark):
    df = spark.createDataFrame(windows(200), "sentence_id string, masked string")
    got = [tuple(r) for r in c.similar_pairs(df, "sentence_id", "masked", k=200).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(windows(200), 0.6)


def test_compare_against_brute_force():
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(-40, 40), rng.randrange(0, 12))), np.int32) for _ in range(120)]
    everyone = np.arange(120)
    x, y = c._compare(sets, everyone, everyone, 0.6)
    held = [set(s.tolist()) for s in sets]
    true = {(i, j) for i in range(120) for j in range(i + 1, 120) if len(held[i] & held[j]) >= 0.6 * len(held[i] | held[j])}
    assert set(zip(x.tolist(), y.tolist())) == true
    a, b = np.arange(50), np.arange(50, 120)
    x, y = c._compare(sets, a, b, 0.6)
    assert set(zip(x.tolist(), y.tolist())) == {(i, j) for i, j in true if i < 50 <= j}


def test_centroids_have_settled(spark):
    df = spark.createDataFrame(corpus(400), "sentence_id string, masked string")
    model = c.fit(c.word_sets(df, "sentence_id", "masked"))
    assert model.k == round(2 * model.n**0.5)
    x = c._matrix(model.points.select("words").toArrow()["words"].combine_chunks(), model.weights, model.dims)

    def cost(centroids):
        return float((1 - (x @ centroids.T).max(1)).sum())

    before, home = cost(model.centroids), (x @ model.centroids.T).argmax(1)
    moved = np.array([x[home == k].sum(0) if (home == k).any() else v for k, v in enumerate(model.centroids)])
    assert before - cost(moved / np.linalg.norm(moved, axis=1, keepdims=True).clip(1e-9)) <= 2e-3 * before
    assert model.costs[-2] - model.costs[-1] <= 1e-3 * model.costs[-2] and abs(model._cost(model.centroids) - before) < 0.01


def test_summary(spark):
    rows = corpus(120)
    df = spark.createDataFrame(rows, "sentence_id string, masked string")
    members = c.cluster_members(df, "sentence_id", "masked", k=8)
    held = {r.key: (r.cluster_id, r.closeness) for r in members.collect()}
    assert set(held) == {k for k, t in rows if k and t is not None}
    lines = c.cluster_summary(members, df, "sentence_id", "masked", typical=3).collect()
    for cluster in {x for x, _ in held.values()}:
        mine = sorted((-close, k) for k, (x, close) in held.items() if x == cluster)
        got = sorted((r["rank"], r.key, r["size"]) for r in lines if r.cluster_id == cluster)
        assert got == [(n + 1, k, len(mine)) for n, (_, k) in enumerate(mine[:3])]


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert c.similar_pairs(empty, "sentence_id", "masked").count() == 0
    assert c.cluster_members(empty, "sentence_id", "masked").count() == 0


def test_many_copies_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(c, "COPIES", 7)
    rows = [(f"k{n:02}", "one and the same wording" if n % 2 else "another wording " + "abcdefgh"[n % 5]) for n in range(60)]
    df = spark.createDataFrame(rows * 2, "sentence_id string, masked string")
    got = [tuple(r) for r in c.similar_pairs(df, "sentence_id", "masked").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.6)
