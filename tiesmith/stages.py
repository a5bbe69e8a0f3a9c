"""The stages from tables in a folder to tables in a folder, with a manifest each.

Every stage reads Parquet tables by name from `src`, writes Parquet to `out` and returns its counts. Folders are
names on any file system that Spark can reach; nothing is kept on the driver's disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import UTC, datetime
from itertools import batched, count
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tiesmith.operators import annotate, assemble, attributes, clean, density, fetching, graph, masking, mentions, resolve, seed, segment
from tiesmith.schemas import TABLES
from tiesmith.session import durable
from tiesmith.sources import files, jsonl, runs
from tiesmith.sources.wiki import WikiClient, WikiError, chunked, humans_query, metadata_query

SENTENCE = ["doc_id", "section_idx", "sent_idx"]


#: Answers that are held before they are written, and missing titles that a report names.
HELD, SHOWN = 2000, 20


class Stage:
    """Tables of one stage and what it counted."""

    def __init__(self, name: str, spark: SparkSession, src: Path | str, out: Path | str) -> None:
        self.name, self.spark, self.src, self.out, self.read_from = name, spark, str(src), str(out), {}

    def read(self, table: str) -> DataFrame:
        self.read_from[table] = files.join(self.src, f"{table}.parquet")
        return self.spark.read.parquet(self.read_from[table])

    def write(self, table: str, df: DataFrame) -> DataFrame:
        path = files.join(self.out, f"{table}.parquet")
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def lines(self, table: str, at: str | None = None) -> DataFrame:
        """A table of JSON lines that only grows; empty before its first row."""
        path = files.join(at or self.out, f"{table}.jsonl")
        files.make_folder(self.spark, path)
        return jsonl.read_jsonl(self.spark, path, table)

    def append(self, table: str, rows: Iterable[dict[str, Any]]) -> None:
        """Add rows to a table of JSON lines, a bounded number at a time. `fetched_at` and `seq` say which came last."""
        number = count()
        for part in batched(rows, HELD):
            stamped = [{"fetched_at": datetime.now(UTC).isoformat(), "seq": next(number)} | r for r in part]
            layout = _layout(table)
            df = self.spark.createDataFrame([tuple(r.get(f.name) for f in layout.fields) for r in stamped], layout)
            jsonl.append_jsonl(df.coalesce(1), files.join(self.out, f"{table}.jsonl"))

    def done(self, counts: DataFrame | dict, **config) -> dict:
        held = counts if isinstance(counts, dict) else counts.first().asDict()
        runs.write_manifest(self.out, stage=self.name, config=config, counts=held, inputs=self.read_from, spec=SPECS[self.name], spark=self.spark)
        return held


#: What each stage implements, for its manifest.
SPECS = {
    "seed": "corpus", "fetch": "corpus", "estimate": "corpus", "clean": "corpus", "resolve": "mentions", "segment": "mentions", "mentions": "mentions",
    "cluster": "typology", "cluster-sweep": "typology", "detect-attributes": "attributes", "assemble-relations": "relations", "render-graph": "graph",
}
_LAST = ["fetched_at", "seq"]


def _layout(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def _limited(df: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """The first rows by key; 0 keeps none, None keeps all."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def run_seed(spark: SparkSession, out: Path | str, client: WikiClient, query: str) -> dict:
    rows = client.sparql(query)
    data = [(n, r.get("person"), r.get("article"), r.get("birthYear"), r.get("deathYear"), r.get("gender")) for n, r in enumerate(rows)]
    df = spark.createDataFrame(data, "ord bigint, person string, article string, birth string, death string, gender string")
    from tiesmith.functions.text import lenient_int, title_from_article_url, url_tail

    flat = df.select("ord", url_tail("person").alias("qid"), title_from_article_url("article").alias("title"), lenient_int("birth").alias("birth_year"), lenient_int("death").alias("death_year"), url_tail("gender").alias("gender"))
    stage = Stage("seed", spark, out, out)
    people = stage.write("seed", seed.fill_gaps(flat, "qid", ["ord"], ["title"], ["birth_year", "death_year", "gender"]).orderBy("qid"))
    return stage.done(seed.seed_quality(people))


def run_fetch(spark: SparkSession, src: Path | str, out: Path | str, client: WikiClient, limit: int | None = None) -> dict:
    """Fetch the pages that aren't stored yet, one request at a time, as the rate asks for; every attempt is logged."""
    stage = Stage("fetch", spark, src, out)
    people, pages = stage.read("seed"), files.join(stage.out, "html")
    files.make_folder(spark, pages)
    stage.lines("fetch_log")
    stored = jsonl.read_pages(spark, pages).select("qid")
    todo = _limited(fetching.still_to_do(people, stored, "qid"), limit, "qid")
    tally = {"fetched": 0, "failed": 0}

    def attempts() -> Iterable[dict[str, Any]]:
        for person in todo.orderBy("qid").toLocalIterator():
            row = {"qid": person.qid, "title": person.title, "fetched_at": datetime.now(UTC).isoformat()}
            try:
                page = client.page_html(person.title)
                files.write_bytes(spark, files.join(pages, f"{person.qid}.html"), page.html)
                tally["fetched"] += 1
                yield row | {"status": "ok", "revision_id": page.revision_id, "url": page.url, "bytes": len(page.html)}
            except WikiError as error:
                tally["failed"] += 1
                yield row | {"status": "error", "error": str(error)}

    stage.append("fetch_log", attempts())
    return stage.done(tally, limit=limit)


def run_clean(spark: SparkSession, src: Path | str, out: Path | str, strict: bool = True) -> dict:
    stage = Stage("clean", spark, src, out)
    last = fetching.latest_ok(stage.lines("fetch_log", stage.src), "qid", _LAST)
    documents = stage.write("documents", clean.clean(jsonl.read_pages(spark, files.join(stage.src, "html")), stage.read("seed"), last, strict))
    return stage.done(clean.clean_counts(documents), strict=strict)


def _claims(client: WikiClient, qids: list[str]) -> Iterable[dict[str, Any]]:
    """What is known of a bounded number of items: whether they are people, and those people's years, gender and occupations."""
    tail = lambda url: url.rsplit("/", 1)[-1]
    year = lambda v: int(v) if v and v.lstrip("+-").isdigit() else None
    people = {tail(r["item"]) for r in chunked(qids, lambda part: client.sparql(humans_query(part), "POST"), HELD)}
    rows: dict[str, list[dict]] = {}
    for r in chunked(sorted(people), lambda part: client.sparql(metadata_query(part), "POST"), HELD // 2):
        rows.setdefault(tail(r["item"]), []).append(r)
    for qid in qids:
        first = {k: v for r in reversed(rows.get(qid, [])) for k, v in r.items()}
        gender = first.get("gender")
        yield {
            "qid": qid, "missing": False, "is_human": qid in people, "birth_year": year(first.get("birthYear")), "death_year": year(first.get("deathYear")), "gender": gender and tail(gender),
            "occupations": sorted({tail(r["occ"]) for r in rows.get(qid, []) if "occ" in r}),
        }


def run_resolve(spark: SparkSession, src: Path | str, out: Path | str, client: WikiClient, limit: int | None = None) -> dict:
    """Titles to items, items to claims; what the caches hold isn't asked again. `limit` keeps the most frequent titles."""
    stage = Stage("resolve", spark, src, out)
    links = resolve.exploded_links(stage.read("documents"))
    titles = durable(resolve.most_frequent(resolve.target_frequency(links, ["doc_id", "section_idx", "link_idx"]), limit))
    cached = lambda table, key: fetching.last_of_key(stage.lines(table), key, _LAST).drop(*_LAST)
    todo = durable(fetching.still_to_do(titles, stage.lines("title_qid"), "title").select("title"))
    for asked in batched((r.title for r in todo.orderBy("title").toLocalIterator()), HELD):
        steps = spark.createDataFrame([(s["kind"], s["source"], s["target"]) for s in client.page_steps(asked)], "kind string, source string, target string")
        found = resolve.items_of_titles(spark.createDataFrame([(t,) for t in asked], "title string"), steps)
        stage.append("title_qid", (r.asDict() for r in found.toLocalIterator()))
    known = cached("title_qid", "title")
    items = known.where("qid IS NOT NULL").select("qid").distinct()
    open_ = durable(fetching.still_to_do(items, stage.lines("qid_claims"), "qid").select("qid"))
    for asked in batched((r.qid for r in open_.orderBy("qid").toLocalIterator()), HELD):
        stage.append("qid_claims", _claims(client, list(asked)))
    resolved = stage.write("wikidata_cache", resolve.resolve_titles(titles, known, cached("qid_claims", "qid").drop("missing", "method")))
    jsonl.write_jsonl(resolved, files.join(stage.out, "wikidata_cache.jsonl"), ["title"], compress=True)
    return stage.done(resolve.resolve_counts(resolved), limit=limit)


def run_segment(spark: SparkSession, src: Path | str, out: Path | str, limit: int | None = None) -> dict:
    stage = Stage("segment", spark, src, out)
    documents = _limited(stage.read("documents"), limit, "doc_id")
    sections = documents.select("doc_id", F.posexplode("sections").alias("section_idx", "s")).select("doc_id", "section_idx", F.col("s.text").alias("text"))
    units = durable(segment.units(sections))
    stage.write("sentences", units.drop("paragraph", "merged"))
    return stage.done(segment.segment_counts(units), limit=limit)


def run_mentions(spark: SparkSession, src: Path | str, out: Path | str, strict: bool = True, most_people: int = mentions.MOST_PEOPLE, limit: int | None = None) -> dict:
    stage = Stage("mentions", spark, src, out)
    documents, sentences, cache, people = _limited(stage.read("documents"), limit, "doc_id"), stage.read("sentences"), stage.read("wikidata_cache"), stage.read("seed")
    links = resolve.exploded_links(documents)
    coverage = resolve.require_coverage(links.select(F.col("target_title").alias("title")), cache, strict and limit is None)
    placed = durable(mentions.person_links(links, resolve.human_index(cache), sentences))
    named = durable(mentions.subject_mentions(documents).unionByName(mentions.as_mentions(placed)))
    every = stage.write("mentions", named.drop("name"))
    known = mentions.with_people(every.where("mention_type = 'link'"), every.where("mention_type = 'subject'"))
    pairs = mentions.candidate_pairs(known, most_people)
    text = sentences.select(*SENTENCE, F.col("text").alias("sentence"))
    ends = every.where("mention_type = 'link'").select("doc_id", "section_idx", "start", "end").distinct()
    for side in ("head", "tail"):
        of = ends.select(F.col("doc_id"), F.col("section_idx"), F.col("start").alias(f"{side}_start"), F.struct("start", "end").alias(f"{side}_span"))
        pairs = pairs.join(of, ["doc_id", "section_idx", f"{side}_start"], "left")
    candidates = stage.write("candidates", pairs.join(text, SENTENCE).select("candidate_id", *SENTENCE, "sentence", "head_entity_id", "tail_entity_id", "head_span", "tail_span", "rule", "people_in_sentence"))
    names = cache.where("qid IS NOT NULL").groupBy(F.col("qid").alias("entity_id")).agg(F.max("gender").alias("_g"), F.max("birth_year").alias("_b"), F.max("death_year").alias("_d"), F.max("occupations").alias("occupations"))
    seeded = people.select(F.col("qid").alias("entity_id"), F.col("gender").alias("_sg"), F.col("birth_year").alias("_sb"), F.col("death_year").alias("_sd"))
    rolled = mentions.roll_up(named, people).join(names, "entity_id", "left").join(seeded, "entity_id", "left")
    entities = stage.write("entities", rolled.select(F.col("entity_id").alias("qid"), "canonical_name", "in_seed", "mention_count", "doc_count", "doc_ids", F.coalesce("_sb", "_b").alias("birth_year"), F.coalesce("_sd", "_d").alias("death_year"), F.coalesce("_sg", "_g").alias("gender"), F.coalesce("occupations", F.array().cast("array<string>")).alias("occupations")))
    counts = {r.rule: r.n for r in candidates.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts |= {"mentions": every.count(), "entities": entities.count(), "docs_without_pairs": mentions.without_pairs(documents, candidates).count(), "suppressed": mentions.suppressed(known, most_people).agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]}
    counts |= {"documents": documents.count(), "link_mentions": every.where("mention_type = 'link'").count()} | mentions.link_counts(links, placed).first().asDict()
    return stage.done(counts | {f"targets_{k}": v for k, v in coverage.items()}, strict=strict, most_people=most_people, limit=limit)


def _keyed(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("sentence_id", F.concat_ws(":", *[F.col(c).cast("string") for c in SENTENCE]))


def _starts(sentences: DataFrame) -> DataFrame:
    return _keyed(sentences).select("sentence_id", "start")


def run_attributes(spark: SparkSession, src: Path | str, out: Path | str, limit: int | None = None, annotator: Callable = annotate.by_rule) -> dict:
    stage = Stage("detect-attributes", spark, src, out)
    pairs = _keyed(_limited(stage.read("candidates"), limit, *SENTENCE, "candidate_id"))
    annotated = stage.write("sentence_annotations", annotate.annotate(pairs.select("sentence_id", F.col("sentence").alias("text")), annotator=annotator))
    located = attributes.with_participants(pairs, stage.read("entities"), _starts(stage.read("sentences")))
    spans = stage.write("attribute_spans", attributes.named_spans(annotated).unionByName(attributes.action_spans(located, annotated)))
    rates = attributes.action_rates(located, spans.where("attr_type = 'action'")).first().asDict()
    return stage.done(rates | {r.attr_type: r.spans for r in attributes.attribute_counts(spans).collect()}, limit=limit)


def run_assemble(spark: SparkSession, src: Path | str, out: Path | str, least: float = assemble.LEAST_COVERAGE) -> dict:
    stage = Stage("assemble-relations", spark, src, out)
    located = attributes.with_participants(_keyed(stage.read("candidates")), stage.read("entities"), _starts(stage.read("sentences")))
    records = durable(assemble.relations(located, stage.read("attribute_spans"), stage.read("sentence_annotations")))
    for name, part in zip(("relations", "low_coverage_relations"), assemble.split_by_coverage(records, least)):
        written = stage.write(name, part)
        assemble.rendered(written).orderBy("relation_id").select(F.concat("block", F.lit("\n")).alias("value")).write.mode("overwrite").text(files.join(stage.out, f"{name}_summary"))
    return stage.done(assemble.coverage_counts(records, least), least=least)


def run_graph(spark: SparkSession, src: Path | str, out: Path | str, institution: str, high_coverage_only: bool = False, engine: str | None = None) -> dict:
    from tiesmith.functions.text import slug

    stage = Stage("render-graph", spark, src, out)
    matched = graph.at_institution(graph.pool(stage.read("relations"), stage.read("low_coverage_relations"), high_coverage_only), institution)
    whole = durable(graph.complete(matched))
    order = ["source_rank", "sentence_id", "relation_id"]
    found = graph.nodes(whole, stage.read("entities"))
    lines = graph.edges(whole, order).join(graph.tooltips(whole, order), ["a", "b"])
    name = spark.range(1).select(slug(F.lit(institution)).alias("s")).first().s
    counts = graph.write_graph(found, lines, stage.out, name, engine)
    return stage.done(counts | {"relations": whole.count(), "skipped_null_participant": matched.count() - whole.count()}, institution=institution, high_coverage_only=high_coverage_only)


def _vectors(stage: Stage, limit: int | None) -> DataFrame:
    candidates, found = stage.read("candidates"), stage.read("mentions")
    spans = masking.people_spans(found, _starts(stage.read("sentences")))
    once = masking.masked(masking.distinct_sentences(candidates, limit), spans, masking.subject_names(found, stage.read("entities")))
    return durable(once.withColumn("embedding", density.embed(F.col("masked_sentence"))))


def run_cluster(spark: SparkSession, src: Path | str, out: Path | str, components: int = 15, least_size: int = 5, method: str = "eom", limit: int | None = None, neighbours: int = 15, metric: str = "cosine") -> dict:
    stage = Stage("cluster", spark, src, out)
    vectors = _vectors(stage, limit)
    config = {"components": components, "neighbours": neighbours, "metric": metric, "least_size": least_size, "method": method, "n_sentences": vectors.count(), "embedder": "hashed_words"}
    stage.write("sentence_embeddings", vectors.select("sentence_id", "embedding"))
    reduced = durable(density.reduce(vectors, "sentence_id", "embedding", components, neighbours, metric))
    labels = stage.write("relation_clusters", density.density_clusters(reduced, "sentence_id", "reduced", least_size=least_size, method=method))
    labelled = reduced.select("sentence_id", "sentence", "reduced").join(labels, "sentence_id")
    stage.write("cluster_summary", density.summary(labelled, "sentence_id", "sentence", "reduced", config))
    row = labels.agg(F.count(F.lit(1)).alias("sentences"), F.countDistinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("clusters"), F.count_if(F.col("cluster_id") < 0).alias("noise"))
    return stage.done(row, **config)


def run_sweep(spark: SparkSession, src: Path | str, out: Path | str, components: list[int], grid: list[tuple[int, str]], limit: int | None = 5000, neighbours: Sequence[int] = (15,), metric: str = "cosine", best: int = 0) -> dict:
    """Every setting over the first sentences; the `best` most even ones get the typical sentences of their largest clusters."""
    stage = Stage("cluster-sweep", spark, src, out)
    vectors = _vectors(stage, limit)
    reduced = density.reductions(vectors, "sentence_id", "embedding", components, neighbours, metric)
    labels = durable(density.settings_labels(reduced, "sentence_id", grid))
    results = stage.write("sweep_results", density.sweep_summary(labels, density.SETTING))
    jsonl.write_jsonl(results, files.join(stage.out, "sweep_results.json"), ["largest_cluster_fraction", *density.SETTING], one_file=True)  # a row a setting
    if best:
        typical = density.best_exemplars(reduced, labels, results, "sentence_id", best)
        stage.write("sweep_exemplars", typical.join(vectors.select("sentence_id", "sentence"), "sentence_id"))
    return stage.done({"settings": results.count()}, components=components, neighbours=list(neighbours), metric=metric, grid=[list(g) for g in grid], limit=limit, best=best)


def run_estimate(spark: SparkSession, out: Path | str, client: WikiClient, titles: list[str], sample: int = 40, seed_number: int = 7) -> dict:
    """Exact sizes of all titles, and the ratio of HTML to them from a seeded sample of pages."""
    stage = Stage("estimate", spark, out, out)
    found = [(r["title"], r["length"]) for r in client.page_info(titles)]
    sizes = spark.createDataFrame(found, "title string, length bigint").where("length IS NOT NULL")
    known = {title for title, length in found if length is not None}
    missing = [t for t in titles if t not in known]
    drawn = fetching.seeded_sample(sizes, "title", sample, seed_number).collect()
    rich = spark.createDataFrame([(r.title, len(client.page_html(r.title).html)) for r in drawn], "title string, html bigint")
    exact = sizes.agg(F.count(F.lit(1)).alias("pages"), F.sum("length").alias("total"), F.max("length").alias("largest")).first().asDict()
    ratios = fetching.size_estimate(sizes.join(rich, "title"), "length", "html").first().asDict()
    return stage.done(exact | {k: v for k, v in ratios.items() if k.startswith("ratio")} | {"missing": len(titles) - exact["pages"], "missing_titles": missing[:SHOWN]}, sample=sample)
