import random
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tiesmith.llm import pairs, terms


@pytest.mark.parametrize(
    ("raw", "shown"),
    [
        ("Niels_Bohr", "Niels Bohr"), (" niels  Bohr ", "Niels Bohr"), ("./Ciri%C3%AB_Juvardal?action=edit&redlink=1", "Cirië Juvardal"), ("A &amp; B&#x27;s rule#History", "A & B's rule"),
        ("école", "École"), ("https://en.example.org/wiki/X%26Y", "X&Y"), ("C+ plus", "C+ plus"), ("", None), ("  ", None), (None, None), ("#Only", None), ("%zz", "%zz"), ("ßeta", "ßeta"),
    ],
)
def test_article_title(raw, shown):
    assert terms.article_title(raw) == shown


@given(st.text(max_size=30))
def test_article_title_is_stable(raw):
    once = terms.article_title(raw)
    assert once is None or once == once.strip() and "  " not in once


def test_frequency_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(terms, "HELD", 20)
    rng = random.Random(1)
    rows = [[rng.choice(["Hot"] * 30 + [f"t{k}" for k in range(90)] + [None, " "]) for _ in range(rng.randrange(0, 8))] for _ in range(300)] + [None, []]
    got = {r.term: r for r in terms.term_frequency(spark.createDataFrame([(r, "x", 1) for r in rows], "t array<string>, term string, records int"), "t").collect()}
    clean = [[terms.article_title(t) for t in r or [] if terms.article_title(t)] for r in rows]
    occurs, present = Counter(t for r in clean for t in r), Counter(t for r in clean for t in set(r))
    assert {t: (r.occurrences, r.records) for t, r in got.items()} == {t: (occurs[t], present[t]) for t in occurs}
    assert {t for t, r in got.items() if r.mark == "rare"} == {t for t in present if present[t] == 1}
    assert {t for t, r in got.items() if r.mark == "common"} == {t for t in present if present[t] > 0.05 * len(rows)}
    assert sorted(r.term_id for r in got.values()) == list(range(len(got)))
    assert [t for t, _ in sorted(got.items(), key=lambda x: x[1].term_id)] == sorted(got)


def test_blocks_of_identifiers(spark, monkeypatch):
    monkeypatch.setattr(terms, "BLOCK_BITS", 3)
    rows = [[f"t{k:03}"] * (k % 3 + 1) for k in range(100)]
    got = terms.term_frequency(spark.createDataFrame([(r,) for r in rows], "t array<string>"), "t").collect()
    assert {r.term: r.occurrences for r in got} == {f"T{k:03}": k % 3 + 1 for k in range(100)}


def test_no_terms(spark):
    assert terms.term_frequency(spark.createDataFrame([], "t array<string>"), "t").count() == 0
    assert terms.term_frequency(spark.createDataFrame([(None,), ([],)], "t array<string>"), "t").count() == 0


def brute(rows):
    groups = {}
    for g, h, i in rows:
        if None not in (g, h, i):
            groups.setdefault((g, h), set()).add(i)
    single = Counter(i for s in groups.values() for i in s)
    both = Counter(p for s in groups.values() for p in combinations(sorted(s), 2))
    return len(groups), single, both


@pytest.mark.parametrize(("block", "bits"), [(2, 31), (64, 31), (64, 3)])
def test_pairs_against_brute_force(spark, monkeypatch, block, bits):
    monkeypatch.setattr(pairs, "RUN", 50)
    monkeypatch.setattr(pairs, "ID_BITS", bits)
    rng = random.Random(9)
    rows = [(rng.randrange(20), rng.randrange(3), f"e{int(rng.expovariate(0.3))}") for _ in range(900)] + [(7, 0, f"x{k}") for k in range(30)] + [(None, 1, "a"), (1, None, "a"), (1, 1, None)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows] * 2, "g int, h int, item string, code string, n int")
    n, single, both = brute(rows)
    got = {(r.item_a, r.item_b): r for r in pairs.together(df, ["g", "h"], "item", block=block).collect()}
    assert {p: r.n_ab for p, r in got.items()} == dict(both)
    for (a, b), r in got.items():
        assert (r.n_a, r.n_b, r.n) == (single[a], single[b], n)
        x, y, z, w = both[a, b] + 0.5, single[a] - both[a, b] + 0.5, single[b] - both[a, b] + 0.5, n - single[a] - single[b] + both[a, b] + 0.5
        assert r.odds_ratio == pytest.approx(x * w / (y * z))
    few = {(r.item_a, r.item_b) for r in pairs.together(df, ["g", "h"], "item", least=3, least_lift=1.2, block=block).collect()}
    assert few == {(a, b) for (a, b), c in both.items() if c >= 3 and c * n >= 1.2 * single[a] * single[b]}


def test_pairs_of_nothing(spark):
    schema = "g int, h int, item string"
    assert pairs.together(spark.createDataFrame([], schema), ["g", "h"], "item").count() == 0
    assert pairs.together(spark.createDataFrame([(1, 1, "a")], schema), ["g", "h"], "item").count() == 0
