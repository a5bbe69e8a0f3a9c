import json
from datetime import datetime, timedelta

import pytest
import yaml
from pyspark.sql import functions as F

from tiesmith.operators import resolve
from tiesmith.sources import jsonl, runs, wiki


class Transport:
    """Stored answers, and what was asked for."""

    def __init__(self, answer):
        self.answer, self.asked = answer, []

    def __call__(self, method, url, params, headers):
        self.asked.append((method, url, dict(params)))
        got = self.answer(method, url, params)
        return got if isinstance(got, wiki.Answer) else wiki.Answer(200, json.dumps(got), {})


def client(answer, **how):
    clock = {"t": 0.0, "slept": []}

    def sleep(s):
        clock["slept"].append(s)
        clock["t"] += s

    t = Transport(answer)
    return wiki.WikiClient("me@example.org", t, clock=lambda: clock["t"], sleep=sleep, **how), t, clock


def test_rate_and_retries():
    answers = [wiki.Answer(503, "", {}), wiki.Answer(429, "", {"Retry-After": "7"}), {"results": {"bindings": [{"x": {"value": "1"}}]}}]
    c, t, clock = client(lambda *_: answers.pop(0))
    assert c.sparql("q") == [{"x": "1"}] and len(t.asked) == 3 and 1.0 in clock["slept"] and 7.0 in clock["slept"]
    with pytest.raises(wiki.WikiError, match="gave up"):
        client(lambda *_: wiki.Answer(500, "", {}), tries=2)[0].sparql("q")
    with pytest.raises(wiki.WikiError, match="not found"):
        client(lambda *_: wiki.Answer(404, "", {}))[0].page_html("X")
    with pytest.raises(ValueError, match="contact"):
        wiki.WikiClient("")


def test_long_queries_go_by_post_and_broken_answers_are_seen():
    c, t, _ = client(lambda *_: {"results": {"bindings": []}})
    c.sparql("q" * 3000)
    c.sparql("q")
    assert [m for m, *_ in t.asked] == ["POST", "GET"]
    for body in ('{"results": {"bindings": [{"x"\nSPARQL-QUERY: queryStr=q', '{"results": {"bindings": []}} java.util.concurrent.TimeoutException'):
        with pytest.raises(wiki.QueryTruncated):
            client(lambda *_, body=body: wiki.Answer(200, body, {}))[0].sparql("q")
    for body in ('{"results": {"bindings": [{"x"', "[]", '{"results": 1}', "<html>"):
        with pytest.raises(wiki.WikiError, match="no answer") as error:
            client(lambda *_, body=body: wiki.Answer(200, body, {}))[0].sparql("q")
        assert not isinstance(error.value, wiki.QueryTruncated)


def test_connection_errors_are_tried_again():
    answers = [ConnectionError("down"), TimeoutError("slow"), wiki.Answer(400, "", {}), {"results": {"bindings": []}}]

    def answer(*_):
        got = answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    c, t, clock = client(answer)
    assert c.sparql("q") == [] and len(t.asked) == 4 and {1.0, 2.0, 4.0} <= set(clock["slept"])
    answers[:] = [ConnectionError("down")] * 3
    with pytest.raises(wiki.WikiError, match="gave up after 3 tries.*down"):
        client(answer, tries=3)[0].page_html("X")


def test_steps_and_items(spark):
    found = {"query": {"normalized": [{"from": "a_b", "to": "A b"}, {"from": "t", "to": "T"}], "redirects": [{"from": "A b", "to": "C"}, {"from": "t", "to": "U"}], "pages": [{"title": "C", "pageprops": {"wikibase_item": "Q3"}}, {"title": "U"}, {"title": "T", "pageprops": {"wikibase_item": "Q9"}}]}}
    c, *_ = client(lambda *_: found)
    steps = spark.createDataFrame([tuple(s.values()) for s in c.page_steps(["a_b", "t", "x"])], "kind string, source string, target string")
    titles = spark.createDataFrame([("a_b",), ("t",), ("x",)], "title string")
    got = {(r.title, r.resolved_title, r.qid) for r in resolve.items_of_titles(titles, steps).collect()}
    assert got == {("a_b", "C", "Q3"), ("t", "U", None), ("x", "x", None)} == {tuple(r.values()) for r in c.page_props(["a_b", "t", "x"])}


def test_queries_for_people():
    q = wiki.people_query("Q169470")
    assert all(f"?{v}" in q.partition("WHERE")[0] for v in ("person", "article", "birthYear", "deathYear", "gender")) and "wdt:P106/wdt:P279* wd:Q169470" in q and q.count("{") == q.count("}") == 4
    assert "P279*" in wiki.people_count_query("Q1") and "P279*" not in wiki.people_count_query("Q1", narrower=False)


def test_halving_asks_each_id_once():
    seen = []

    def ask(part):
        if len(part) > 100:
            raise wiki.QueryTruncated("x")
        seen.extend(part)
        return [p.lower() for p in part]

    ids = [f"Q{k}" for k in range(730)]
    assert list(wiki.chunked(ids, ask, 400)) == [i.lower() for i in ids] and seen == ids
    with pytest.raises(wiki.QueryTruncated):
        list(wiki.chunked(ids, lambda p: (_ for _ in ()).throw(wiki.QueryTruncated("x")), 30))


def test_titles_and_pages():
    def answer(method, url, params):
        if "rest_v1" in url:
            return wiki.Answer(200, "<p>é", {"ETag": 'W/"77/abc"'})
        if params["prop"] == "info":
            return {"query": {"normalized": [{"from": "a_b", "to": "A b"}], "redirects": [{"from": "A b", "to": "C"}], "pages": [{"title": "C", "length": 5}, {"title": "D", "missing": True}]}}
        return {"query": {"normalized": [{"from": "a_b", "to": "A b"}], "redirects": [{"from": "A b", "to": "C"}], "pages": [{"title": "C", "pageprops": {"wikibase_item": "Q3"}}]}}

    c, t, _ = client(answer)
    assert [(r["title"], r["resolved_title"], r["length"]) for r in c.page_info(["a_b", "D"])] == [("a_b", "C", 5), ("D", "D", None)]
    assert [(r["redirected_from"], r["lastrevid"], r["missing"]) for r in c.page_info(["a_b", "D"])] == [("A b", None, False), (None, None, True)]
    assert list(c.page_props(["a_b", "x"])) == [{"title": "a_b", "resolved_title": "C", "qid": "Q3"}, {"title": "x", "resolved_title": "x", "qid": None}]
    page = c.page_html("A b/c")
    assert (page.revision_id, page.html.decode(), page.url.endswith("title=A_b/c&oldid=77")) == (77, "<p>é", True) and t.asked[-1][1].endswith("A_b%2Fc")
    assert len(list(client(lambda *_: {"query": {"pages": []}})[0].page_info([str(k) for k in range(120)]))) == 0


def stored(method, url, params, headers):
    return wiki.Answer(200, json.dumps({"query": {"pages": [{"title": t, "length": len(t)} for t in params["titles"].split("|")]}}), {})


def test_data_source(spark):
    spark.dataSource.register(wiki.WikiSource)
    df = spark.read.format("wiki").options(kind="page_info", contact="me", transport="tests.test_sources:stored", titles="One\nThree", delay="0").load()
    assert [(r.title, r.length) for r in df.collect()] == [("One", 3), ("Three", 5)] and df.rdd.getNumPartitions() == 1


def test_jsonl(spark, tmp_path):
    rows = spark.createDataFrame([("Q2", "ü", None, 1980, None), ("Q1", "b", 1, None, "g")], "qid string, title string, birth_year int, death_year int, gender string")
    path = str(tmp_path / "seed.jsonl")
    jsonl.write_jsonl(rows, path, ["qid"], one_file=True)
    text = next((tmp_path / "seed.jsonl").glob("part-*")).read_text(encoding="utf-8")
    assert [json.loads(line)["qid"] for line in text.splitlines()] == ["Q1", "Q2"] and '"birth_year":null' in text and "ü" in text
    jsonl.append_jsonl(rows, path)
    assert jsonl.read_jsonl(spark, path, "seed").count() == 4
    jsonl.write_jsonl(rows, path, ["qid"], compress=True)
    assert list((tmp_path / "seed.jsonl").glob("*.gz")) and jsonl.read_jsonl(spark, path, "seed").count() == 2
    (tmp_path / "blank.jsonl").write_text('{"qid":"Q1"}\n\n{"qid":"Q2"}\n')
    assert [r.title for r in jsonl.read_jsonl(spark, str(tmp_path / "blank.jsonl"), "seed").collect()] == [None, None]
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "Q1.html").write_text("<p>x")
    (tmp_path / "html" / "Q2.html").write_text("")
    assert [(r.qid, bytes(r.html)) for r in jsonl.read_pages(spark, str(tmp_path / "html")).collect()] == [("Q1", b"<p>x")]
    assert jsonl.content_hashes(spark, str(tmp_path / "html" / "Q1.html")).first().sha256 == runs.file_hash(tmp_path / "html" / "Q1.html")


def test_manifests_and_layers(tmp_path):
    (tmp_path / "in").write_text("x")
    one = runs.write_manifest(tmp_path, stage="seed", config={"a": 1}, counts={"n": 2}, inputs={"in": tmp_path / "in", "none": tmp_path / "none"})
    two = runs.write_manifest(tmp_path, stage="fetch", config={}, counts={}, inputs={"dir": tmp_path})
    held = json.loads(one.read_text())
    assert one != two and held["inputs"]["in"]["sha256"] == runs.file_hash(tmp_path / "in") and held["inputs"]["none"]["sha256"] is None and held["counts"] == {"n": 2}
    (tmp_path / "v.json").write_text('{"corpus": "0.0.2"}')
    versions = runs.load_versions(tmp_path / "v.json")
    assert runs.layer_dir("corpus", tmp_path, versions) == tmp_path / "corpus" / "0.0.2"
    assert runs.load_versions(tmp_path / "v.json", {"corpus"}) == versions
    with pytest.raises(KeyError, match="graph"):
        runs.load_versions(tmp_path / "v.json", {"corpus", "graph"})
    with pytest.raises(ValueError, match="corpus"):
        runs.load_versions(tmp_path / "v.json", set())
    with pytest.raises(KeyError):
        runs.layer_dir("graph", tmp_path, versions)
    with pytest.raises(ValueError, match="unknown"):
        runs.layer_dir("graph", tmp_path, versions, {"corpus"})


def test_manifests_on_any_file_system(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "one").write_text("x")
    uri = tmp_path.as_uri()
    path = runs.write_manifest(f"{uri}/out", stage="seed", config={}, counts={}, inputs={"t": f"{uri}/t.parquet", "one": f"{uri}/one", "none": f"{uri}/none"}, spec="s1", spark=spark)
    held = json.loads((tmp_path / "out" / "_manifest.seed.json").read_text())
    assert path == f"{uri}/out/_manifest.seed.json" and held["spec"] == "s1" and held["inputs"]["none"]["sha256"] is None
    assert held["inputs"]["t"]["sha256"] == runs.file_hash(tmp_path / "t.parquet") and held["inputs"]["one"]["sha256"] == runs.file_hash(tmp_path / "one")


GOOD = {"type_id": "mentor", "label": "m", "definition": "d", "direction": "directed", "cluster_ids": [0, 2], "clustering_run_id": "r", "wikidata_properties": ["P184"], "examples": ["e"]}


def test_typology(spark, tmp_path):
    path = tmp_path / "t.yaml"
    path.write_text(yaml.safe_dump([GOOD]))
    types = runs.load_typology(path)
    table = runs.typology_table(spark, types)
    path.write_text(yaml.safe_dump([GOOD | {"direction": "symmetric"}]))
    assert runs.load_typology(path)[0].direction == "symmetric"
    summary = spark.createDataFrame([(0, "r"), (2, "r")], "cluster_id int, clustering_run_id string")
    runs.require_clusters(table, summary)
    with pytest.raises(runs.TypologyError, match="mentor: 2"):
        runs.require_clusters(table, summary.where("cluster_id = 0"))
    for bad in [{"direction": "up"}, {"direction": "undirected"}, {"cluster_ids": [True]}, {"cluster_ids": []}, {"label": " "}, {"wikidata_properties": ["184"]}, {"wikidata_properties": ["P1\n"]}, {"examples": "e"}]:
        path.write_text(yaml.safe_dump([GOOD | bad]))
        with pytest.raises(runs.TypologyError):
            runs.load_typology(path)
    for entries in ([GOOD, GOOD], {"a": 1}, ["x"], [{k: v for k, v in GOOD.items() if k != "label"}]):
        path.write_text(yaml.safe_dump(entries))
        with pytest.raises(runs.TypologyError):
            runs.load_typology(path)


def test_streams(spark, tmp_path):
    from tiesmith.operators.segment import segment
    from tiesmith.streaming import ingest

    folder = tmp_path / "in"
    folder.mkdir()
    docs = [{"doc_id": f"d{k}", "title": "t", "sections": [{"heading": "", "text": f"One {k}. Two.\n\nThree.", "links": []}]} for k in range(6)]
    for n, part in enumerate((docs[:2], docs[2:4])):
        (folder / f"{n}.jsonl").write_text("\n".join(map(json.dumps, part)))
    go = lambda: ingest.write_sentences(ingest.read_documents(spark, str(folder), files_a_batch=1), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    go()
    (folder / "2.jsonl").write_text("\n".join(map(json.dumps, docs[4:])))
    go()
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "section_idx", "sent_idx", "start", "end", "text")
    whole = segment(ingest.sections(spark.read.schema("doc_id string, title string, sections array<struct<heading:string,text:string,links:array<string>>>").json(str(folder))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and got.count() == 18

    log = tmp_path / "log"
    base = datetime(2024, 1, 10)
    spark.createDataFrame([(1, base, "ok"), (1, base, "ok"), (2, base + timedelta(days=1), "error")], "doc_id int, logged_at timestamp, status string").write.parquet(str(log))
    stream = ingest.fetch_rates(spark.readStream.schema("doc_id int, logged_at timestamp, status string").parquet(str(log)))
    stream.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.status, r.attempts) for r in spark.table("rates").collect()) == [("error", 1), ("ok", 1)]
    assert F is not None
