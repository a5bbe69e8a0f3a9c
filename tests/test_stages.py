import json

import pytest

from tiesmith import cli, stages
from tiesmith.sources.wiki import Answer, WikiClient

PAGES = {
    "Ann Lee": "<section><p>Ann Lee worked with <a rel='mw:WikiLink' href='./Bo_Ray'>Bo Ray</a> and <a rel='mw:WikiLink' href='./Cy_Fox'>Cy Fox</a> at the University of Rome in 1901. She met <a rel='mw:WikiLink' href='./Rome'>Rome</a> folk.</p></section>",
    "Bo Ray": "<section><p>He knew nobody.</p></section>",
}
ITEMS = {"Bo Ray": "Q2", "Cy Fox": "Q3", "Rome": "Q220", "Ann Lee": "Q1"}


def transport(method, url, params, headers):
    if "rest_v1" in url:
        title = url.rsplit("/", 1)[-1].replace("_", " ")
        return Answer(200, PAGES[title], {"etag": f'"{len(title)}/x"'})
    if "sparql" in url and "P31" in params["query"]:
        return Answer(200, json.dumps({"results": {"bindings": [{"item": {"value": f"http://e/{q}"}} for q in ("Q1", "Q2", "Q3") if f"wd:{q} " in params["query"]]}}), {})
    if "sparql" in url and "P569" in params["query"]:
        return Answer(200, json.dumps({"results": {"bindings": [{"item": {"value": "http://e/Q2"}, "birthYear": {"value": "1870"}, "gender": {"value": "http://e/Q6581097"}, "occ": {"value": "http://e/Q9"}}]}}), {})
    if "sparql" in url:
        rows = [("Q1", "Ann_Lee", "1880"), ("Q1", "Ann_Lee", "1881"), ("Q2", "Bo_Ray", None)]
        return Answer(200, json.dumps({"results": {"bindings": [{"person": {"value": f"http://e/{q}"}, "article": {"value": f"https://x/wiki/{t}"}} | ({"birthYear": {"value": y}} if y else {}) for q, t, y in rows]}}), {})
    titles = params["titles"].split("|")
    if params.get("prop") == "info":
        return Answer(200, json.dumps({"query": {"pages": [{"title": t, "length": 100} for t in titles]}}), {})
    return Answer(200, json.dumps({"query": {"pages": [{"title": t, "pageprops": {"wikibase_item": ITEMS[t]}} for t in titles if t in ITEMS]}}), {})


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    data = tmp_path_factory.mktemp("data")
    client = WikiClient("me", transport, delay=0)
    counts = {"seed": stages.run_seed(spark, data, client, "SELECT"), "fetch": stages.run_fetch(spark, data, data, client)}
    counts |= {"again": stages.run_fetch(spark, data, data, client), "clean": stages.run_clean(spark, data, data), "resolve": stages.run_resolve(spark, data, data, client)}
    counts |= {"resolve again": stages.run_resolve(spark, data, data, client), "segment": stages.run_segment(spark, data, data), "mentions": stages.run_mentions(spark, data, data)}
    counts |= {"attributes": stages.run_attributes(spark, data, data), "assemble": stages.run_assemble(spark, data, data, 0.3), "graph": stages.run_graph(spark, data, data, "university")}
    counts |= {"estimate": stages.run_estimate(spark, data, client, ["Ann Lee", "Bo Ray"], 1)}
    return data, counts


def test_counts(run):
    _, c = run
    assert (c["seed"]["people"], c["seed"]["with_variants"]) == (2, 1)
    assert c["fetch"] == {"fetched": 2, "failed": 0} and c["again"] == {"fetched": 0, "failed": 0}
    assert (c["clean"]["documents"], c["clean"]["links"]) == (2, 3)
    assert c["resolve"] == c["resolve again"] and c["resolve"]["human_titles"] == 2 and c["resolve"]["titles"] == 3
    assert c["segment"]["sentences"] == 3
    assert (c["mentions"]["subject_link"], c["mentions"]["link_link"], c["mentions"]["mentions"], c["mentions"]["docs_without_pairs"]) == (2, 1, 4, 1)
    assert c["attributes"]["candidates"] == 3 and c["attributes"]["time"] == 1 and c["attributes"]["institution"] == 1 and c["attributes"]["action"] == 3
    assert c["assemble"]["records"] == 3 and c["graph"]["edges"] == 3 and c["graph"]["nodes"] == 3
    assert (c["estimate"]["pages"], c["estimate"]["total"], c["estimate"]["missing"], c["estimate"]["missing_titles"]) == (2, 200, 0, [])
    assert (c["mentions"]["documents"], c["mentions"]["link_mentions"], c["mentions"]["non_person_links"], c["mentions"]["links_outside_sentence"]) == (2, 2, 1, 0)
    assert (c["segment"]["paragraphs"], c["segment"]["merges"]) == (2, 0)


def test_tables(spark, run):
    data, _ = run
    entities = {r.qid: r for r in spark.read.parquet(str(data / "entities.parquet")).collect()}
    assert (entities["Q2"].birth_year, entities["Q2"].gender, entities["Q2"].occupations, entities["Q2"].in_seed) == (1870, "Q6581097", ["Q9"], True)
    assert entities["Q1"].birth_year == 1880 and not entities["Q3"].in_seed and entities["Q3"].canonical_name == "Cy Fox"
    pairs = spark.read.parquet(str(data / "candidates.parquet")).collect()
    assert {(p.head_entity_id, p.tail_entity_id, p.rule) for p in pairs} == {("Q1", "Q2", "subject_link"), ("Q1", "Q3", "subject_link"), ("Q2", "Q3", "link_link")}
    assert all(p.tail_span is not None and (p.head_span is None) == (p.rule == "subject_link") for p in pairs)
    text = spark.read.parquet(str(data / "documents.parquet")).where("qid = 'Q1'").first().sections[0].text
    assert {text[p.tail_span.start : p.tail_span.end] for p in pairs} == {"Bo Ray", "Cy Fox"}
    assert json.loads((data / "_manifest.mentions.json").read_text())["inputs"]["sentences"]["sha256"]
    assert "graph relations" in (data / "university.dot").read_text()


def test_clusters(spark, run):
    data, _ = run
    out = stages.run_cluster(spark, data, data, components=2, least_size=2)
    assert out["sentences"] == 1 and out["noise"] == 1
    assert stages.run_sweep(spark, data, data, [1], [(2, "eom"), (2, "leaf")])["settings"] == 2
    assert len(next((data / "sweep_results.json").glob("part-*")).read_text().splitlines()) == 2
    assert stages.run_sweep(spark, data, data, [1], [(2, "eom")], neighbours=[2, 3], best=1)["settings"] == 2


def test_later_answers_win(spark, tmp_path):
    stage = stages.Stage("resolve", spark, tmp_path, tmp_path)
    stage.append("title_qid", [{"title": "a", "qid": "Q1"}, {"title": "b", "qid": None}, {"title": "a", "qid": "Q2"}])
    stage.append("title_qid", [{"title": "b", "qid": "Q3"}])
    rows = stages.fetching.last_of_key(stage.lines("title_qid"), "title", ["fetched_at", "seq"]).collect()
    assert {r.title: r.qid for r in rows} == {"a": "Q2", "b": "Q3"}


def test_folders_are_uris(spark, run, tmp_path):
    data, counts = run
    again = stages.run_segment(spark, data.as_uri(), tmp_path.as_uri())
    assert again == counts["segment"] and (tmp_path / "sentences.parquet").exists()
    assert json.loads((tmp_path / "_manifest.segment.json").read_text())["inputs"]["documents"]["sha256"]


def test_command_line(run, capsys):
    data, _ = run
    assert cli.main(["segment", "--src", str(data), "--out", str(data / "again")]) == 0
    assert json.loads(capsys.readouterr().out)["sentences"] == 3
    assert cli.main(["relations-summary", "--src", str(data)]) == 0 and "Q1 -- Q2" in capsys.readouterr().out
    assert cli.main(["cluster-summary", "--src", str(data)]) == 0 and "(no clusters)" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["fetch"])
