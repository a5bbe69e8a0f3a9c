import itertools
import random

from pyspark.sql import functions as F

from tiesmith.llm import leakage
from tiesmith.llm.text import WORD, fold, settle

ITEM = "Statement: archives of heavy dispute are gradually invented as obituary whenever linear balances have built more plates."
DOC = "doc_id bigint, text string, item_id string, block string"
ITEMS = "item_id bigint, text string, doc_id string"


def found(spark, texts, items=((1, ITEM),)):
    docs = spark.createDataFrame([(n, t, "x", "y") for n, t in enumerate(texts)], DOC)
    rows = leakage.leaks(docs, spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS)).collect()
    return {(r.doc_id, r.item_id): r for r in rows}


def test_disguises_do_not_hide_an_item(spark):
    whole = ITEM.rstrip(".")
    texts = [
        f"Before. {ITEM} After.", ITEM.upper(), ITEM.replace(" ", "\n"), ITEM.replace("dispute", "dis­pu​te"), ITEM.replace("obituary", "obi-\ntuary"),
        ITEM.replace("dispute", "<b>dis</b>pute"), ITEM.replace("heavy", '<a href="./X_y">heavy</a>'), ITEM.replace("heavy", "[heavy](./Some_page)").replace("linear", "**linear**"),
        ITEM.replace("dispute", "quarrel").replace("built", "film"), ITEM.replace("are", "are eagerly and slowly"), " ".join(whole.split()[:12]) + " ...", ITEM.replace("archives", "árchivés"),
        ITEM.replace("heavy", "\\href{./Law_of_the_second_kind\\%2C_old}{heavy}").replace("linear", "{\\it linear}"), ITEM.replace("heavy", "{{lang|xx|heavy}} $a + b = c$ <math> \\sum_{i=2}^{9} n_{i} < k </math>"),
    ]
    assert set(found(spark, texts)) == {(n, 1) for n in range(len(texts))}


def test_parts_and_other_orders_do_not_count(spark):
    words = ITEM.split()
    shuffled = random.Random(3).sample(words, len(words))
    spread = " ".join(f"{w} one two three four five six seven" for w in words)
    assert not found(spark, [" ".join(words[:9]), " ".join(reversed(words)), " ".join(shuffled), spread])


def test_scattered_words_in_order_are_found(spark):
    item = [f"word{chr(97 + k)}" for k in range(18)]
    gaps = " ".join(f"other{k}" if k in (1, 3, 5, 7, 9, 11, 13) else w for k, w in enumerate(item))
    rng, texts = random.Random(4), [gaps]
    for _ in range(60):
        kept = set(rng.sample(range(18), 11))
        texts.append("before it " + " ".join(w if k in kept else "foreign" for k, w in enumerate(item)) + " after")
    less = " ".join(w if k < 10 else "foreign" for k, w in enumerate(item))
    assert set(found(spark, [*texts, less], [(1, " ".join(item)), (2, "worda of quite another kind here")])) == {(n, 1) for n in range(61)}


def test_offsets_cut_the_passage(spark):
    text = f"Intro here. {ITEM} Outro."
    row = found(spark, [text])[0, 1]
    assert text[row.start_char : row.end_char] == ITEM.rstrip(".")
    assert (row.matched, row.item_words, row.longest) == (17, 17, 17)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (None, ITEM), (2, ""), (3, ITEM), (3, ITEM), (4, "word " * 200_000 + ITEM)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None), (None, ITEM), (9, "")], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()) == [(3, 7), (4, 7)]
    assert leakage.leaks(docs, items.limit(0)).count() == 0
    assert leakage.leaks(docs.limit(0), items).count() == 0


def test_one_word_items_and_ties(spark):
    assert set(found(spark, ["the unicorn ran", "no such"], [(1, "Unicorn"), (2, "unicorn")])) == {(0, 1), (0, 2)}


def test_blocks_give_the_same(spark, monkeypatch):
    items = [(n, f"{ITEM} number{n} extra{n} thing{n}") for n in range(6)]
    texts = [t for _, t in items]
    whole = set(found(spark, texts, items))
    monkeypatch.setattr(leakage, "blocks", lambda i: itertools.batched([(k, [fold(w) for w in WORD.findall(settle(t))]) for k, t in items], 2))
    assert set(found(spark, texts, items)) == whole


def test_automaton_against_brute_force():
    rng = random.Random(5)
    items = [[rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(6)]
    automaton = leakage.SuffixAutomaton(items)
    for _ in range(60):
        text = [rng.randrange(4) for _ in range(20)]
        held = {tuple(i[a:b]) for i in items for a in range(len(i)) for b in range(a + 1, len(i) + 1)}
        longest = [max((n for n in range(1, e + 2) if tuple(text[e + 1 - n : e + 1]) in held), default=0) for e in range(20)]
        ends = {e: (n, s) for e, n, s in automaton.matches(text, 0)}
        assert set(ends) == {e for e in range(20) if longest[e] >= 2}
        for e, (n, state) in ends.items():
            assert n == longest[e]
            piece = text[e + 1 - n : e + 1]
            assert set(automaton.ends[state]) == {(k, b - 1) for k, i in enumerate(items) for b in range(n, len(i) + 1) if i[b - n : b] == piece}
            each = {k: max((m for m in range(2, n + 1) for a in range(len(i)) if i[a : a + m] == text[e + 1 - m : e + 1]), default=0) for k, i in enumerate(items)}
            assert automaton.holders(state, n) == {k: m for k, m in each.items() if m}


def test_decontaminate_cuts_once(spark):
    text = f"Keep this. {ITEM} And this."
    docs = spark.createDataFrame([(1, text, "old"), (2, "plain", "old"), (3, None, "old")], "doc_id bigint, text string, clean_text string")
    rows = {r.doc_id: r.clean_text for r in leakage.decontaminate(docs, spark.createDataFrame([(1, ITEM), (2, ITEM)], "item_id bigint, text string")).collect()}
    assert rows == {1: "Keep this. . And this.", 2: "plain", 3: None}


def test_long_runs_are_cut_whatever_their_share(spark):
    item = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    texts = ["Before " + " ".join(item[a : a + n]) + " after" for a, n in ((20, 20), (0, 12), (3, 11))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    rows = {r.doc_id: r.clean_text for r in leakage.decontaminate(docs, items).collect()}
    assert rows == {0: "Before  after", 1: "Before  after", 2: texts[2]}
    assert {(r.doc_id, r.longest) for r in leakage.leaks(docs, items, most_longest=12).collect()} == {(0, 20), (1, 12)}
    assert leakage.leaks(docs, items).count() == 0


def test_settle_keeps_length():
    for t in ["a&amp;b <i>x</i> [a](b) ​ z-\n z", "{{x}} [[A|b]] __c__", ""]:
        assert len(settle(t)) == len(t)
    assert F is not None
