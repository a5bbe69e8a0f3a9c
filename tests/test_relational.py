import pytest
from pyspark.sql import functions as F

from tiesmith.operators import fetching, mentions, resolve, seed


def test_gaps_are_filled_in_order(spark):
    rows = [("Q1", 1, "T1", 1900, None), ("Q1", 2, "T2", 1901, 1980), ("Q2", 1, None, None, None), (None, 1, "x", 1, 1)]
    df = spark.createDataFrame(rows, "qid string, n int, title string, birth int, death int")
    got = {r.qid: (r.title, r.birth, r.death, r.variants) for r in seed.fill_gaps(df, "qid", ["n"], ["title"], ["birth", "death"]).collect()}
    assert got == {"Q1": ("T1", 1900, 1980, 1), "Q2": (None, None, None, 0)}


def test_occupations_are_sorted_and_never_null(spark):
    df = spark.createDataFrame([("Q1", 1, None, None, None, "Q9"), ("Q1", 2, 5, None, "g", "Q3"), ("Q1", 3, 6, None, None, "Q9"), ("Q2", 1, None, None, None, None)], "qid string, n int, birth_year int, death_year int, gender string, occupation string")
    got = {r.qid: (r.birth_year, r.gender, r.occupations) for r in seed.collapse_metadata(df, ["n"]).collect()}
    assert got == {"Q1": (5, "g", ["Q3", "Q9"]), "Q2": (None, None, [])}


def test_log_and_cache(spark):
    log = spark.createDataFrame([(1, "error", 1), (1, "ok", 2), (1, "ok", 3), (1, "ok", 3), (2, "error", 1)], "doc_id int, status string, ord int")
    assert [(r.doc_id, r.ord) for r in fetching.latest_ok(log, "doc_id", ["ord"]).collect()] == [(1, 3)]
    assert {(r.doc_id, r.status) for r in fetching.last_of_key(log, "doc_id", ["ord"]).collect()} == {(1, "ok"), (2, "error")}
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    assert {r.doc_id for r in fetching.still_to_do(wanted, log.where("status = 'ok'"), "doc_id").collect()} == {2, 3}


def test_samples_repeat(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 3)
    a, b = ([r.id for r in fetching.seeded_sample(df, "id", 9, 5).collect()] for _ in range(2))
    assert a == b and len(a) == 9
    assert {r.g: r.n for r in fetching.seeded_sample(df, "id", 4, 5, ["g"]).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()} == {0: 4, 1: 4, 2: 4}


def test_aliases_stop_after_four_hops(spark):
    aliases = spark.createDataFrame([(c, chr(ord(c) + 1), 1) for c in "abcdefg"] + [("x", "old", 1), ("x", "new", 2)], "source string, target string, ord int")
    titles = spark.createDataFrame([("a",), ("g",), ("x",), ("none",)], "title string")
    assert {r.title: r.resolved_title for r in resolve.chase_aliases(titles, aliases).collect()} == {"a": "e", "g": "h", "x": "new", "none": "none"}


def test_three_answers(spark):
    titles = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2), ("d", 1), ("absent", 9)], "title string, link_instances bigint")
    cache = spark.createDataFrame([("a", "Q1"), ("b", None), ("c", "Q3"), ("d", "Q4")], "title string, qid string")
    claims = spark.createDataFrame([("Q1", True), ("Q4", False)], "qid string, is_human boolean")
    rows = resolve.resolve_titles(titles, cache, claims)
    assert {r.title: (r.is_human, r.claims_resolved) for r in rows.collect()} == {"a": (True, True), "b": (False, True), "c": (None, False), "d": (False, True)}
    counts = resolve.resolve_counts(rows).first()
    assert (counts.titles, counts.human_titles, counts.unknown_titles, counts.red_titles, counts.human_rate) == (4, 1, 1, 1, 0.4286)
    assert resolve.resolve_counts(rows.limit(0)).first().human_rate == 0.0


def test_guard(spark):
    targets = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",)], "title string")
    cache = spark.createDataFrame([("a", True), ("b", None), ("c", False)], "title string, claims_resolved boolean")
    assert resolve.require_coverage(targets, cache, strict=False) == {"targets": 4, "absent": 1, "open": 1}
    with pytest.raises(resolve.IncompleteCache, match="1 of 4"):
        resolve.require_coverage(targets, cache)


def test_points_in_intervals(spark):
    points = spark.createDataFrame([(1, 0), (1, 19), (1, 20), (1, 21), (1, 22), (1, 9000), (2, 5), (3, 1)], "doc int, at int")
    held = spark.createDataFrame([(1, 0, 20, "a"), (1, 22, 40, "b"), (1, 50, 9001, "long"), (2, 6, 9, "c"), (2, 5, 5, "empty")], "doc int, start int, end int, name string")
    got = {(r.doc, r.at): r.name for r in mentions.locate(points, held, ["doc"], "at", ["name"], bin_width=8).collect()}
    assert got == {(1, 0): "a", (1, 19): "a", (1, 20): None, (1, 21): None, (1, 22): "b", (1, 9000): "long", (2, 5): None, (3, 1): None}


def corpus(spark, entities):
    """One sentence of document 1 about S with the given linked people."""
    docs = spark.createDataFrame([(1, "S", "Subject"), (2, None, "Other")], "doc_id int, qid string, title string")
    links = spark.createDataFrame([(f"1:0:{n}", 1, 0, 0, n, n + 1, e, e, "link") for n, e in enumerate(entities)], "mention_id string, doc_id int, section_idx int, sent_idx int, start int, end int, surface string, entity_id string, mention_type string")
    return docs, links, mentions.with_people(links, mentions.subject_mentions(docs))


@pytest.mark.parametrize(
    ("entities", "subject", "linked"),
    [(["A", "B"], 2, 1), (["A", "A"], 2, 0), (["S", "A"], 1, 1), (["A", "B", "A"], 3, 2), (list("ABCDE"), 5, 10), (list("ABCDEF"), 6, 0), ([*"ABCDE", "S"], 5, 15)],
)
def test_pairs(spark, entities, subject, linked):
    _, _, people = corpus(spark, entities)
    pairs = mentions.candidate_pairs(people).collect()
    assert sum(p.rule == "subject_link" for p in pairs) == subject
    assert sum(p.rule == "link_link" for p in pairs) == linked
    assert all(p.people_in_sentence == len({*entities, "S"}) for p in pairs)
    assert all(p.head_start < p.tail_start for p in pairs if p.rule == "link_link")


def test_suppressed_and_documents_without_pairs(spark):
    docs, _, people = corpus(spark, [*"ABCDEF", "A"])
    assert [(r.doc_id, r.pairs) for r in mentions.suppressed(people).collect()] == [(1, 15)]
    assert [r.doc_id for r in mentions.without_pairs(docs, mentions.candidate_pairs(people)).collect()] == [2]


def test_roll_up(spark):
    rows = [(d, None, None, f"name{d}", "S") for d in range(60, 0, -1)] + [(5, 0, 3, "later", "T"), (5, 0, 1, "first", "T"), (7, None, None, "other", "T")]
    df = spark.createDataFrame(rows, "doc_id int, section_idx int, start int, surface string, entity_id string")
    got = {r.entity_id: r for r in mentions.roll_up(df, spark.createDataFrame([("S",), ("S",)], "qid string")).collect()}
    assert (got["S"].mention_count, got["S"].doc_count, got["S"].doc_ids, got["S"].canonical_name, got["S"].in_seed) == (60, 60, list(range(1, 51)), "name1", True)
    assert (got["T"].mention_count, got["T"].doc_count, got["T"].canonical_name, got["T"].in_seed) == (3, 2, "first", False)


def test_link_mentions(spark):
    links = spark.createDataFrame([(1, 0, 5, 9, "Bohr", "Niels Bohr"), (1, 0, 21, 25, "gap", "Niels Bohr"), (1, 0, 6, 9, "x", "City")], "doc_id int, section_idx int, start int, end int, surface string, target_title string")
    sentences = spark.createDataFrame([(1, 0, 0, 0, 20), (1, 0, 1, 22, 40)], "doc_id int, section_idx int, sent_idx int, start int, end int")
    humans = spark.createDataFrame([("Niels Bohr", "Q7085")], "title string, qid string")
    assert [(r.mention_id, r.sent_idx, r.entity_id) for r in mentions.link_mentions(links, humans, sentences).collect()] == [("1:0:5", 0, "Q7085")]


def test_names_and_counts_of_links(spark):
    links = spark.createDataFrame([(1, 0, 5, 9, "Bohr", "N Bohr"), (1, 0, 21, 25, "gap", "N Bohr"), (1, 0, 6, 9, "x", "City"), (1, 0, 24, 26, "Ann", "Ann Lee")], "doc_id int, section_idx int, start int, end int, surface string, target_title string")
    sentences = spark.createDataFrame([(1, 0, 0, 0, 20), (1, 0, 1, 22, 40)], "doc_id int, section_idx int, sent_idx int, start int, end int")
    cache = spark.createDataFrame([("N Bohr", "Niels Bohr", "Q7", True), ("N Bohr", "Bohr", "Q7", True), ("Ann Lee", "", "Q8", True), ("City", "City", "Q9", False)], "title string, resolved_title string, qid string, is_human boolean")
    found = mentions.person_links(links, resolve.human_index(cache), sentences)
    assert tuple(mentions.link_counts(links, found).first()) == (1, 1)
    rolled = mentions.roll_up(mentions.as_mentions(found), spark.createDataFrame([], "qid string")).collect()
    assert {r.entity_id: r.canonical_name for r in rolled} == {"Q7": "Niels Bohr", "Q8": "Ann Lee"}


def test_limit_keeps_the_most_frequent_titles(spark):
    rows = [(1, n, t) for n, t in enumerate("zzbbbac")]
    frequency = resolve.target_frequency(spark.createDataFrame(rows, "doc int, n int, target_title string"), ["doc", "n"])
    assert [(r.title, r.link_instances) for r in resolve.most_frequent(frequency, 3).collect()] == [("b", 3), ("z", 2), ("a", 1)]
    assert resolve.most_frequent(frequency, 0).count() == 0 and resolve.most_frequent(frequency, None).count() == 4


def test_estimate_of_nothing_and_something(spark):
    df = spark.createDataFrame([(10, 20), (20, 80), (0, 5)], "plain int, rich int")
    r = fetching.size_estimate(df, "plain", "rich").first()
    assert (r.pages, r.total, r.mean, r.median, r.largest, r.ratio_mean, r.ratio_weighted) == (3, 30, 10, 10, 20, 3.0, 3.5)
    assert fetching.size_estimate(df.limit(0), "plain", "rich").first().pages == 0


def test_hierarchies(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("x", "y")], "child string, parent string")
    assert {r.item for r in seed.descendants(edges, "a").collect()} == {"a", "b", "c"}
    people = spark.createDataFrame([("Q1", "a"), ("Q2", "c"), ("Q2", "b"), ("Q3", "x")], "qid string, occupation string")
    assert tuple(seed.corpus_counts(people, edges, "a").first()) == (1, 2)
    chain = spark.createDataFrame([(str(k + 1), str(k)) for k in range(5)], "child string, parent string")
    with pytest.raises(ValueError, match="deeper"):
        seed.descendants(chain, "0", most_rounds=3)
