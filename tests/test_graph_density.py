import numpy as np
import pytest
from pyspark.sql import functions as F

from tiesmith.functions.claims import run_id
from tiesmith.operators import density, graph

RECORD = "relation_id string, sentence_id string, sentence string, participants array<struct<mention_id:string,qid:string>>, attributes array<struct<attr_type:string,value:string,span:struct<start:int,end:int>,source:string>>, coverage double"
YALE = ("institution", "Yale <College>", None, "ner")


def record(name, a, b, *attrs, coverage=0.9):
    return name, f"s{name}", f'Sentence "{name}"', [(a, a), (b, b)], list(attrs), coverage


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD)


def test_filter_and_collapse(spark):
    kept = frame(spark, record("r1", "Q1", "Q2", YALE, ("action", "wrote to", None, "dep")), record("r2", "Q2", "Q1", ("place", "Yale", None, "ner")), record("r3", "Q1", None, YALE), record("r6", "Q1", "Q2", ("institution", None, None, "ner")))
    low = frame(spark, record("r4", "Q2", "Q1", ("institution", "yale", None, "ner"), coverage=0.1), record("r5", "Q3", "Q3", YALE, coverage=0.1))
    assert {r.relation_id for r in graph.at_institution(graph.pool(kept, low), "YALE").collect()} == {"r1", "r3", "r4", "r5"}
    assert {r.relation_id for r in graph.at_institution(graph.pool(kept, low, True), "yale").collect()} == {"r1", "r3"}
    whole = graph.complete(graph.at_institution(graph.pool(kept, low), "yale"))
    order = ["source_rank", "relation_id"]
    edges = graph.edges(whole, order).join(graph.tooltips(whole, order), ["a", "b"])
    row = edges.collect()
    assert [(r.a, r.b, r.n_relations, r.tooltip) for r in row] == [("Q1", "Q2", 2, 'Sentence "r1"\nSentence "r4"')] and row[0].attributes[1].value == "wrote to"
    nodes = graph.nodes(whole, spark.createDataFrame([("Q1", 'Ann "A"')], "qid string, canonical_name string"))
    assert {r.qid: r.label for r in nodes.collect()} == {"Q1": 'Ann "A"', "Q2": "Q2", "Q3": "Q3"}
    dot = graph.to_dot(nodes, edges)
    assert dot == graph.to_dot(nodes.orderBy(F.desc("qid")), edges) and dot.startswith("graph relations {") and dot.endswith("}\n")
    assert '"Q1" [id="node__Q1", label="Ann \\"A\\""];' in dot and 'ID="box__Q1__Q2__institution" TOOLTIP="Institution: Yale &lt;College&gt;"' in dot and 'tooltip="Sentence \\"r1\\"\\nSentence' in dot
    assert dot.index("box__Q1__Q2__institution") < dot.index("box__Q1__Q2__action")
    assert {r.id: r.tooltip for r in graph.box_tooltips(edges).collect()} == {"a_box__Q1__Q2__institution": "Institution: Yale <College>", "a_box__Q1__Q2__action": "Action: wrote to"}
    with pytest.raises(ValueError, match="more than 0"):
        graph.to_dot(nodes, edges, most=0)


def test_page():
    svg = '<svg><g id="edge__a__b" class="edge"><title>x</title><path/></g><g id="node__a"><title>keep</title></g></svg>'
    page = graph.to_html(svg, {"edge__a__b": "</script><b>"}, "<t>")
    assert "<title>x</title>" not in page and "<title>keep</title>" in page and "<\\/script>" in page and "&lt;t&gt;" in page and page.count("</script>") == 1


def test_written(spark, tmp_path):
    whole = frame(spark, record("r1", "Q1", "Q2", YALE)).withColumn("source_rank", F.lit(0))
    edges = graph.edges(whole, ["relation_id"]).join(graph.tooltips(whole, ["relation_id"]), ["a", "b"])
    nodes = graph.nodes(whole, spark.createDataFrame([], "qid string, canonical_name string"))
    assert graph.write_graph(nodes, edges, tmp_path, "g") == {"nodes": 2, "edges": 1, "engine": None}
    with pytest.raises(RuntimeError, match="not installed"):
        graph.to_svg((tmp_path / "g.dot").read_text(), "no-such-engine")


def blobs(n=60, d=6, seed=1):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(k * 8, 0.3, (n // 2, d)) for k in (0, 1)])


@pytest.mark.parametrize("method", ["eom", "leaf"])
def test_density_finds_blobs(method):
    points = np.concatenate([blobs(), [[40.0] * 6]])
    labels, strength = density.density_labels(points, 10, method)
    assert labels[60] == -1 and set(labels[:30]) - {-1} and set(labels[:30]) & set(labels[30:60]) <= {-1}
    assert ((strength >= 0) & (strength <= 1)).all() and (method == "leaf" or set(labels[:60]) == {0, 1})
    assert density.density_labels(points[:1], 5)[0].tolist() == [-1] and density.density_labels(points[:0], 5)[0].tolist() == []


def test_frames(spark):
    data = [(f"k{n:02}", p.tolist()) for n, p in enumerate(blobs())]
    df = spark.createDataFrame(data, "k string, v array<double>")
    reduced = density.principal(df, "v", 2)
    assert len(reduced.first().reduced) == 2 and len(density.principal(df, "v", 99).first().reduced) == 6
    rows = density.density_clusters(reduced, "k", "reduced", least_size=10).collect()
    assert len({r.cluster_id for r in rows if r.k < "k30"}) == 1 and len({r.cluster_id for r in rows}) == 2
    with pytest.raises(Exception, match="at most 5"):
        density.density_clusters(reduced, "k", "reduced", most_points=5).collect()
    swept = density.sweep_summary(density.sweep(df, "k", "v", [1, 2], [(10, "eom"), (10, "leaf")]), ["n_components", "least_size", "method"])
    assert swept.count() == 4 and all(r.n_sentences == 60 for r in swept.collect())


@pytest.mark.parametrize("method", ["eom", "leaf"])
def test_blocks_give_the_labels_of_all_points(spark, method):
    rng = np.random.default_rng(5)
    points = np.round(np.concatenate([rng.normal(k * 3, 0.6, (40, 3)) for k in range(3)] + [rng.uniform(-5, 12, (30, 3))]), 1)  # rounded: many equal distances
    points = np.concatenate([points, points[:7]])
    df = spark.createDataFrame([(f"{n:03}", p.tolist()) for n, p in enumerate(points)], "k string, v array<double>")
    labels, strength = density.density_labels(points, 6, method)
    for block in (20, 64, 1000):
        rows = density.density_clusters(df, "k", "v", least_size=6, method=method, block=block).orderBy("k").collect()
        assert [r.cluster_id for r in rows] == labels.tolist() and np.allclose([r.cluster_prob for r in rows], strength)


def test_neighbours_and_metrics(spark):
    rng = np.random.default_rng(3)
    data = [(f"{n:02}", (rng.normal(0, 0.05, 4) + [1, 0, 0, 0] if n % 2 else rng.normal(0, 0.05, 4) + [0, 1, 0, 0]) * (1 + n)) for n in range(40)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in data] + [("null", None)], "k string, v array<double>").where("v IS NOT NULL")
    spread = {}
    for near in (0, 8):
        rows = {r.k: np.array(r.reduced) for r in density.reduce(df, "k", "v", 2, near, "cosine").collect()}
        assert len(rows) == 40
        spread[near] = np.std([rows[k] for k, _ in data if int(k) % 2], axis=0).sum()
    assert spread[8] < 0.7 * spread[0]
    assert len(density.reduce(df, "k", "v", 2, 5, "euclidean").first().reduced) == 2 and density.reduce(df.limit(0), "k", "v").count() == 0
    assert len(density.reduce(df.limit(1), "k", "v").collect()) == 1
    with pytest.raises(ValueError, match="metric"):
        density.reduce(df, "k", "v", metric="other")
    reduced = density.reductions(df, "k", "v", [2], [5, 8])
    labels = density.settings_labels(reduced, "k", [(5, "eom")])
    best = density.best_exemplars(reduced, labels, density.sweep_summary(labels, density.SETTING), "k", best=1, most_clusters=2, n=3).collect()
    assert len(best) == 6 and {r["rank"] for r in best} == {1, 2, 3} and len({tuple(r[c] for c in density.SETTING) for r in best}) == 1


def test_exemplars_and_summary(spark):
    data = [("a", 0, [0.0, 0.0], "A"), ("b", 0, [2.0, 0.0], "B"), ("c", 0, [1.0, 0.0], "C"), ("d", 1, [5.0, 5.0], "D"), ("n", -1, [9.0, 9.0], "N")]
    df = spark.createDataFrame(data, "k string, cluster_id int, v array<double>, t string")
    assert [(r["rank"], r.k, r.distance) for r in density.exemplars(df.where("cluster_id = 0"), "k", "cluster_id", "v").orderBy("rank").collect()] == [(1, "c", 0.0), (2, "a", 1.0), (3, "b", 1.0)]
    rows = {r.cluster_id: r for r in density.summary(df, "k", "t", "v", {"x": 1}, 2, 5).collect()}
    assert set(rows) == {0, 1} and rows[0]["size"] == 3 and rows[0].exemplar_sentences == ["C", "A"] and set(rows[0].sample_sentences) == {"A", "B", "C"} and rows[0].clustering_run_id == run_id({"x": 1}) and rows[0].coherence_reviewed_by == []


def test_embedding(spark):
    got = spark.createDataFrame([("Ann met Bo",), ("bo met ann",), ("",), (None,)], "t string").select(density.embed(F.col("t")).alias("v")).collect()
    assert got[0].v == got[1].v and len(got[0].v) == density.DIMS and sum(map(abs, got[2].v)) == 0
    fixed = spark.createDataFrame([("x",)], "t string").select(density.embed(F.col("t"), lambda t: np.ones(3, np.float32)).alias("v"))
    assert fixed.first().v == [1.0, 1.0, 1.0]


def test_rendered():
    from tiesmith.operators import render

    rows = [{"n": 5, "m": "eom", "n_clusters": 2, "noise_fraction": 0.25, "largest_cluster_fraction": 0.5, "top_cluster_sizes": [3, 2]}]
    assert render.sweep_table(rows, ["n", "m"]).splitlines() == ["n  m    n_clusters  noise_fraction  largest_cluster_fraction  top_cluster_sizes", "5  eom           2          0.2500                    0.5000  3,2"]
    shown = render.sweep_exemplars([{"n": 5, "cluster_id": 1, "size": 9, "rank": k, "sentence": f"S{k}"} for k in (2, 1)], ["n"])
    assert shown.splitlines() == ["n=5", "  1 (9)         S1", "                S2"] and render.sweep_exemplars([], ["n"]) == "(no settings expanded)"
    assert render.table([], ["a"]) == "(none)" and render.clusters([]) == "(no clusters)"
    assert render.clusters([{"cluster_id": 10, "size": 3, "exemplar_sentences": ["A", "B"]}, {"cluster_id": 2, "size": 1, "exemplar_sentences": []}]).splitlines() == ["10  3  A", "       B", " 2  1  "]
