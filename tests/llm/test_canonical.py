import random

import pytest

from tiesmith.llm import canonical as c

REFERENCE = [
    (1, "place", "Zusuteshafen"), (2, "place", "Gikeostährden"), (3, "institution", "University of Zusuteshafen"), (4, "institution", "Technical University of Nobikalvik"),
    (5, "institution", "Royal Observatory, Mataramélles"), (6, "institution", "Zusuteshafen Institute of Technology"), (7, "institution", "Mataramélles Laboratory for Low Temperature Physics"),
    *[(100 + k, "institution", f"{a} {b}") for k, (a, b) in enumerate((f"{x}{y}grad", z) for x in ("Bo", "Ke", "Lu") for y in ("rina", "tumo", "wesi") for z in ("Institute of Technology", "Polytechnic", "Museum of Natural History"))],
]
CASES = [
    ("place", "ZUSUTESHAFEN,", 1), ("place", "greater Zusuteshafen", 1), ("place", "Zusutehsafen (town)", 1), ("place", "Gikeostahrden's", 2), ("place", "Gikeotsährden", 2), ("place", "Zusutesmouth", -1),
    ("place", "unknown", -1), ("place", "???", -1), ("place", "", -1), ("institution", "Zusuteshafen University", 3), ("institution", "Univ. of Zusuteshafen", 3), ("institution", "U. of Zusuteshafen", 3),
    ("institution", "Zusuteshafen, University of", 3), ("institution", "Technical University of Zusuteshafen", -1), ("institution", "Tech. Uni of Nobikalvik", 4), ("institution", "University of Nobikalvik", -1),
    ("institution", "the Royal Obs., Mataramelles [sic]", 5), ("institution", "Zusuteshafen Inst of Technol.", 6), ("institution", "Mataramélles Lab. for Low Temp. Physics", 7), ("institution", "Borinagrad Poly.", 101),
    ("institution", "Zusuteshafen", -1), ("INSTITUTION ", "university of zusuteshafen", 3), ("action", "Zusuteshafen", -1),
]


def test_values_and_edges(spark):
    spans = spark.createDataFrame([(n, k, v, "x", 0.0) for n, (k, v, _) in enumerate(CASES)] * 2 + [(900, "place", None, "x", 0.0), (901, None, "Zusuteshafen", "x", 0.0), (None, "place", "Zusuteshafen", "x", 0.0)], "span_id bigint, attr_type string, value string, canonical string, similarity double")
    reference = spark.createDataFrame([*REFERENCE, (9, "place", "Zusuteshafen"), (None, "place", "X"), (10, "place", None)], "ref_id bigint, attr_type string, canonical string")
    rows = c.map_spans(spans, reference).collect()
    got = {r.span_id: r.ref_id for r in rows}
    assert len(rows) == len(got) == len(CASES) - 1
    assert {CASES[n][1]: ref for n, ref in got.items()} == {v: ref for k, v, ref in CASES if k.strip().lower() != "action"}
    assert {r.ref_id for r in c.map_spans(spans, reference.limit(0)).collect()} == {-1}
    assert c.map_spans(spans.limit(0), reference).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    spans = spark.createDataFrame([(n, k, v) for n, (k, v, _) in enumerate(CASES)], "span_id bigint, attr_type string, value string")
    reference = spark.createDataFrame(REFERENCE, "ref_id bigint, attr_type string, canonical string")
    found = {}
    for entries in (1, 3, 50_000):
        monkeypatch.setattr(c, "BLOCK_ENTRIES", entries)
        found[entries] = {(r.span_id, r.ref_id, round(r.similarity, 9)) for r in c.map_spans(spans, reference).collect()}
    assert found[1] == found[3] == found[50_000]
    assert {CASES[n][1]: ref for n, ref, _ in found[1]} == {v: ref for k, v, ref in CASES if k.strip().lower() != "action"}


def test_aliases_and_several_mentions(spark):
    reference = spark.createDataFrame(
        [(1, "place", "Zusuteshafen", ["Zusu Town", None]), (2, "place", "Gikeostährden", None), (3, "place", "Zusu Town Harbour", []), (4, "place", "Old Port", ["Zusuteshafen"])],
        "ref_id bigint, attr_type string, canonical string, others array<string>",
    )
    values = ["zusu town", "in Zusu-Town", "Zusu Town Harbour", "Gikeostährden / Zusuteshafen", "Zusuteshafen", "Old Zusuteshafen"]
    spans = spark.createDataFrame([(n, "place", v) for n, v in enumerate(values)], "span_id bigint, attr_type string, value string")
    assert [r.ref_id for r in c.map_spans(spans, reference, aliases="others").orderBy("span_id").collect()] == [1, 1, 3, 2, 1, -1]
    assert c.chosen([(0, 2, 9, 5), (1, 4, 12, 6), (4, 5, 3, 7), (0, 1, 4, 8)]) == [(1, 4, 12, 6), (0, 1, 4, 8), (4, 5, 3, 7)]


def test_long_values():
    r = c.Resolver([(1, "Zusuteshafen", [])])
    assert r.find("word " * 5000 + "Zusuteshafen") == (1, 1.0)
    assert r.find("x" * 20_000) == (-1, 0.0)


def plain(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_distance_against_plain():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(2))
        for most in (0, 1, 2, 3):
            assert c.distance(a, b, most) == min(plain(a, b), most + 1)


@pytest.mark.parametrize("word", ["zusuteshafen", "abc", "a"])
def test_near_words_share_a_deletion(word):
    rng = random.Random(3)
    for _ in range(100):
        other = list(word)
        for _ in range(c.slips(word)):
            k = rng.randrange(len(other))
            other = rng.choice([other[:k] + other[k + 1 :], [*other[:k], "q", *other[k:]], [*other[:k], "q", *other[k + 1 :]]]) or other
        if c.slips("".join(other)) >= c.slips(word):
            assert c.deletions(word, c.slips(word)) & c.deletions("".join(other), c.slips("".join(other)))
