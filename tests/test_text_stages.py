import pytest
from pyspark.sql import functions as F

from tiesmith.operators import annotate, assemble, attributes, clean, masking, segment

PAGE = """<html><body><!-- gone --><section><p>Lead   about <a rel="mw:WikiLink" href="./Ann_Lee">Ann
 Lee</a> and <a rel="mw:WikiLink nofollow" href="./Red?action=edit&redlink=1"> <span> Red One </span> </a>.<sup class="mw-ref">[1]</sup></p><p>  </p>
<p>Second \U0001f600 <a href="./Not_a_wikilink">x</a> <a rel="mw:WikiLink" href="#frag">f</a> <a rel="mw:WikiLink" href="./B">B</a></p></section>
<section><h2>Career <i>years</i></h2><p>Worked.<section><h3>Deep</h3><p>Inner <a rel="mw:WikiLink" href="./C">C</a></p></section></section>
<section><h2> References </h2><p>dropped</p></section><section><h2>Empty</h2><table><tr><td><p>cell</p></td></tr></table></section></body></html>"""


def test_sections():
    out = clean.parse_html(PAGE)
    assert [s["heading"] for s in out] == ["", "Career years"]
    assert out[0]["text"] == "Lead about Ann Lee and  Red One .\n\nSecond \U0001f600 x f B"
    assert [(x["surface"], x["target_title"]) for x in out[0]["links"]] == [("Ann Lee", "Ann Lee"), ("Red One", "Red"), ("B", "B")]
    assert out[1]["text"].startswith("Worked.") and out[1]["links"][0]["target_title"] == "C"
    assert all(s["text"][x["start"] : x["end"]] == x["surface"] == x["surface"].strip() for s in out for x in s["links"])
    assert clean.parse_html("") == clean.parse_html(None) == [] and clean.parse_html("<p>only") == [{"heading": "", "text": "only", "links": []}]


def test_selectors_are_parameters():
    out = clean.parse_html("<article><p>a <a href='./X_y'>b</a></p><div class='ad'><p>no</p></div></article>", drop=(".ad",), section="article", link="a[href]")
    assert out == [{"heading": "", "text": "a b", "links": [{"start": 2, "end": 3, "surface": "b", "target_title": "X y"}]}]
    with pytest.raises(ValueError, match="selector"):
        clean.Selector("a > b")


def test_clean_frame_and_offsets(spark):
    pages = spark.createDataFrame([("Q1", PAGE.encode()), ("Q2", b""), ("Q3", b"<p>x</p>")], "qid string, html binary")
    seed = spark.createDataFrame([("Q1", "Ann Bo"), ("Q3", "")], "qid string, title string")
    log = spark.createDataFrame([("Q1", 7, "t")], "qid string, revision_id bigint, fetched_at string")
    rows = {r.doc_id: r for r in clean.clean(pages, seed, log).collect()}
    assert set(rows) == {"Q1", "Q3"} and rows["Q1"].url.endswith("title=Ann_Bo&oldid=7") and rows["Q3"].title == "Q3" and rows["Q3"].url is None
    kind = "array<struct<heading:string,text:string,links:array<struct<start:int,end:int,surface:string,target_title:string>>>>"
    bad = spark.createDataFrame([([("", "ab cd", [(0, 2, "ab", "t"), (0, 2, "xx", "t"), (2, 5, " cd", "t")])],)], f"sections {kind}")
    assert bad.select(clean.offset_problems(F.col("sections")).alias("p")).first().p == ["section 0: offset mismatch", "section 0: surrounding blanks"]


def split(spark, *texts):
    df = spark.createDataFrame([(n, 0, t) for n, t in enumerate(texts)], "doc_id int, section_idx int, text string")
    out: dict[int, list] = {}
    for r in segment.segment(df).orderBy("doc_id", "sent_idx").collect():
        assert texts[r.doc_id][r.start : r.end] == r.text
        out.setdefault(r.doc_id, []).append(r.text)
    return out


def test_sentences_by_rule(spark):
    got = split(spark, "Dr. Bo met J. Li. They spoke, e.g. of it! Then?\n\n\n\nNew \U0001f600 one. Last", "", " \n\n ", "A note [see Ann. Lee. Ann died.] ends. Next.", "Never [closed. One. Two. Three. Four. Five. Six.")
    assert got[0] == ["Dr. Bo met J. Li. They spoke, e.g. of it!", "Then?", "New \U0001f600 one.", "Last"] or got[0] == ["Dr. Bo met J. Li.", "They spoke, e.g. of it!", "Then?", "New \U0001f600 one.", "Last"]
    assert 1 not in got and 2 not in got
    assert got[3] == ["A note [see Ann. Lee. Ann died.] ends.", "Next."]
    assert got[4] == ["Never [closed. One. Two. Three. Four.", "Five.", "Six."]


def test_splitters_plug_in(spark):
    df = spark.createDataFrame([(1, 0, "ab|cd")], "doc_id int, section_idx int, text string")
    by_bar = segment.splitter(lambda t: [(0, t.index("|")), (t.index("|") + 1, len(t))])
    assert [r.text for r in segment.segment(df, by_bar).orderBy("sent_idx").collect()] == ["ab", "cd"]


def test_counts_of_units(spark):
    df = spark.createDataFrame([(1, 0, "A [b. Cc] d. Eee.\n\nNext."), (1, 1, "One."), (2, 0, ""), (3, 0, None)], "doc_id int, section_idx int, text string")
    row = segment.segment_counts(segment.units(df)).first()
    assert (row.documents, row.sections, row.paragraphs, row.sentences, row.merges) == (1, 2, 3, 4, 1)
    with pytest.raises(Exception, match="a sentence from"):
        segment.segment(df, segment.splitter(lambda t: [(0, 1), (0, 2)])).collect()


def test_very_long_texts_take_time_in_proportion(spark):
    import time

    long = "It was cold [so they said. Nobody minded] and Dr. Bo left. " * 170_000  # 10 MB in one paragraph
    df = spark.createDataFrame([(1, 0, long)], "doc_id int, section_idx int, text string")
    began = time.time()
    assert segment.segment(df).count() == 170_000
    t = assemble.tokens(F.col("text"), F.array(F.lit("it"), F.lit("was")))
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(5_000_000).alias("end")))
    row = df.select(assemble.coverage(t, spans).alias("c"), F.size(assemble.uncovered(F.col("text"), t, spans)).alias("n")).first()
    assert 0.4 < row.c < 0.6 and row.n == 1
    assert df.select(F.size(segment.paragraphs(F.repeat(F.lit("a b\n\n"), 500_000))).alias("n")).first().n == 500_000
    assert time.time() - began < 60


def test_deep_trees_take_time_in_proportion(spark):
    n = 100_000
    tokens = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.cast("int").alias("i"), (2 * i).cast("int").alias("idx"), F.lit("x").alias("text"), F.greatest(i - 1, F.lit(0)).cast("int").alias("head")))
    place = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    row = spark.range(1).select(attributes.between(tokens, place(0, 2 * n), place(2 * n - 40, 2 * n)).alias("s")).first().s
    assert (row.start, row.end) == (0, 2 * (n - 20) + 1)


def test_paragraph_offsets(spark):
    rows = spark.createDataFrame([("a\n\n\U0001f600b\n\n\n\nc",)], "t string").select(F.explode(segment.paragraphs(F.col("t"))).alias("p")).select("p.*").collect()
    assert [(r.idx, r.start, r.text) for r in rows] == [(0, 0, "a"), (1, 3, "\U0001f600b"), (3, 9, "c")]


TOKENS = [("He", 1), ("met", 1), ("Ann", 1), ("in", 1), ("Rome", 3)]


def parsed(spark):
    at, out = 0, []
    for i, (w, head) in enumerate(TOKENS):
        out.append((i, at, w, head, False, w == "in", False))
        at += len(w) + 1
    return spark.createDataFrame([("s", "He met Ann in Rome", out, [(14, 18, "GPE", "Rome"), (0, 2, "PERSON", "He")])], "sentence_id string, text string, tokens array<struct<i:int,idx:int,text:string,head:int,is_space:boolean,is_stop:boolean,is_punct:boolean>>, ents array<struct<start:int,end:int,label:string,text:string>>")


def test_named_spans(spark):
    assert [(r.attr_type, r.value, r.span.start, r.candidate_id) for r in attributes.named_spans(parsed(spark)).collect()] == [("place", "Rome", 14, None)]


@pytest.mark.parametrize(("head", "tail", "value"), [((7, 10), (14, 18), "met Ann in Rome"), ((0, 2), (7, 10), "He met Ann"), ((0, 2), (0, 2), "He"), ((11, 18), (0, 2), "He met Ann in")])
def test_paths(spark, head, tail, value):
    t = F.col("tokens")
    roots = parsed(spark).select("text", "tokens", attributes.span_root(t, F.lit(head[0]), F.lit(head[1])).alias("h"), attributes.span_root(t, F.lit(tail[0]), F.lit(tail[1])).alias("t"))
    r = roots.select("text", attributes.path_span(t, F.col("h"), F.col("t")).alias("s")).first()
    assert r.text[r.s.start : r.s.end] == value


@pytest.mark.parametrize(
    ("span", "start", "name", "gender", "wanted"),
    [((115, 120), 100, None, None, ("Fermi", "span")), ((10, 12), 100, "Fermi", None, None), (None, 0, "Enrico Fermi (physicist)", None, ("Fermi", "name")), (None, 0, "X", "Q6581097", ("his", "pronoun")), (None, 0, None, "Q6581072", None), (None, 0, None, None, ("his", "pronoun"))],
)
def test_participants(spark, span, start, name, gender, wanted):
    sentence = "With his idea, Fermi left."
    kind = "struct<start:int,end:int>"
    given = F.lit(None).cast(kind) if span is None else F.struct(F.lit(span[0]).alias("start"), F.lit(span[1]).alias("end"))
    r = spark.range(1).select(attributes.locate_participant(F.lit(sentence), given, F.lit(start), F.lit(name).cast("string"), F.lit(gender).cast("string")).alias("p")).first().p
    assert (r and (sentence[r.start : r.end], r.method)) == wanted


def test_default_annotator():
    tokens, ents = annotate.by_rule("In May 1901 she joined the University of Rome in Pisa.")
    assert {(e["label"], e["text"]) for e in ents} == {("DATE", "May 1901"), ("ORG", "University of Rome"), ("GPE", "Pisa")}
    assert all(tokens[t["head"]]["i"] == t["head"] for t in tokens) and sum(t["head"] == t["i"] for t in tokens) == 1
    assert annotate.by_rule("") == ([], [])


def test_attributes_and_relations_end_to_end(spark):
    text = "Bo worked with Ann at the University of Rome in 1901."
    at = lambda w: (text.index(w) + 100, text.index(w) + len(w) + 100)
    candidates = spark.createDataFrame([("c1", "s1", text, "Q1", "Q2", None, at("Ann")), ("c1", "s1", text, "Q1", "Q2", None, at("Ann")), ("c2", "s1", text, "Q9", "Q2", (0, 1), at("Ann")), ("c3", "gone", "...", "Q1", "Q1", None, None)], "candidate_id string, sentence_id string, sentence string, head_entity_id string, tail_entity_id string, head_span struct<start:int,end:int>, tail_span struct<start:int,end:int>")
    entities = spark.createDataFrame([("Q1", "Bo", None), ("Q2", "Ann", None)], "qid string, canonical_name string, gender string")
    annotated = annotate.annotate(candidates.where("sentence_id = 's1'").select("sentence_id", F.col("sentence").alias("text")))
    assert annotated.count() == 1
    located = attributes.with_participants(candidates, entities, spark.createDataFrame([("s1", 100)], "sentence_id string, start int"))
    actions = attributes.action_spans(located, annotated)
    assert {(r.candidate_id, r.value) for r in actions.collect()} == {("c1", "Bo worked with Ann")}
    spans = attributes.named_spans(annotated).unionByName(actions)
    records = assemble.relations(located, spans, annotated)
    rows = sorted(records.collect(), key=lambda r: r.relation_id)
    assert [r.relation_id for r in rows] == ["c1", "c1", "c2", "c3"]
    assert [[a.attr_type for a in r.attributes] for r in rows] == [["institution", "time", "action", "action"]] * 2 + [["institution", "time"], []]
    assert rows[0].coverage == 1.0 and rows[3].coverage == 1.0 and 0 < rows[2].coverage < 1 and "worked" in rows[2].uncovered[0]
    kept, low = assemble.split_by_coverage(records, 1.0)
    assert (kept.count(), low.count()) == (3, 1)
    assert assemble.coverage_counts(records, 1.01).first().low == 4
    assert "uncovered: " in next(r.block for r in assemble.rendered(low).collect())
    rates = attributes.action_rates(located, actions).first()
    assert (rates.candidates, rates.with_action, rates.action_rate) == (4, 2, 0.5)


def test_masking(spark):
    candidates = spark.createDataFrame([(1, 0, 10, "Bo met Ann."), (1, 0, 2, "He left Ann."), (1, 0, 10, "Bo met Ann.")], "doc_id int, section_idx int, sent_idx int, sentence string")
    once = masking.distinct_sentences(candidates)
    assert once.count() == 2 and [r.sent_idx for r in masking.distinct_sentences(candidates, 1).collect()] == [2] and masking.distinct_sentences(candidates, 0).count() == 0
    found = spark.createDataFrame([(1, 0, 10, 57, 60, "Ann", "Q2", "link"), (1, 0, 99, 0, 3, "Ann", "Q2", "link"), (1, None, None, None, None, "Bo", "Q1", "subject")], "doc_id int, section_idx int, sent_idx int, start int, end int, surface string, entity_id string, mention_type string")
    starts = spark.createDataFrame([("1:0:10", 50), ("1:0:2", 30)], "sentence_id string, start int")
    names = masking.subject_names(found, spark.createDataFrame([], "qid string, canonical_name string"))
    got = {r.sent_idx: r.masked_sentence for r in masking.masked(once, masking.people_spans(found, starts), names).collect()}
    assert got == {10: "[PERSON] met [PERSON].", 2: "He left Ann."}
