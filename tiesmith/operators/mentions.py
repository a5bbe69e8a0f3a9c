"""Mentions of people in sentences, candidate pairs and the roll-up of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: People in a sentence above which the linked ones are a list and aren't paired with each other.
MOST_PEOPLE = 6
#: Code points of a section in one bin of the interval join.
BIN = 2048
SENTENCE = ["doc_id", "section_idx", "sent_idx"]


def locate(points: DataFrame, intervals: DataFrame, by: list[str], at: str, keep: list[str], bin_width: int = BIN) -> DataFrame:
    """Each point with the `keep` columns of the interval [start, end) that holds it, null where none does.

    An equi-join on key and bin with the bounds as a rest condition: a long document spreads over
    many bins, so neither a hot key nor a nested loop arises.
    """
    bins = F.sequence(F.floor(F.col("start") / bin_width), F.floor((F.col("end") - 1) / bin_width))
    held = intervals.where(F.col("end") > F.col("start")).select(*[F.col(b).alias(f"_k_{b}") for b in by], F.explode(bins).alias("_bin"), F.col("start").alias("_start"), F.col("end").alias("_end"), *[F.col(k).alias(f"_v_{k}") for k in keep])
    on = (F.floor(F.col(at) / bin_width) == F.col("_bin")) & (F.col("_start") <= F.col(at)) & (F.col(at) < F.col("_end"))
    for b in by:
        on = on & (F.col(b) == F.col(f"_k_{b}"))
    out = points.join(held, on, "left")
    return out.select(*points.columns, *[F.col(f"_v_{k}").alias(k) for k in keep])


def person_links(links: DataFrame, humans: DataFrame, sentences: DataFrame) -> DataFrame:
    """The links to people with `entity_id`, `name` and the `sent_idx` of the sentence they start in, null where there is none.

    links: doc_id, section_idx, start, end, surface, target_title; humans: title, qid and, if it is known, resolved_title;
    sentences: the sentence key with start and end. The start alone decides; a link may reach beyond its sentence.
    """
    title = F.col("title")
    name = F.coalesce(F.nullif("resolved_title", F.lit("")), title) if "resolved_title" in humans.columns else title
    people = links.join(humans.select(title.alias("target_title"), F.col("qid").alias("entity_id"), name.alias("name")), "target_title")
    return locate(people, sentences, ["doc_id", "section_idx"], "start", ["sent_idx"])


def as_mentions(found: DataFrame) -> DataFrame:
    """Mentions of the rows of `person_links` that lie in a sentence."""
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("section_idx").cast("string"), F.col("start").cast("string"))
    return found.where("sent_idx IS NOT NULL").select(name.alias("mention_id"), *SENTENCE, "start", "end", "surface", "entity_id", F.lit("link").alias("mention_type"), F.lit("wikilink").alias("link_method"), F.lit(1.0).alias("confidence"), "name")


def link_mentions(links: DataFrame, humans: DataFrame, sentences: DataFrame) -> DataFrame:
    """One row for each link to a person that starts within a sentence."""
    return as_mentions(person_links(links, humans, sentences))


def link_counts(links: DataFrame, found: DataFrame) -> DataFrame:
    """One row: links to others than people, and links to people outside all sentences, from the rows of `person_links`."""
    every = links.agg(F.count(F.lit(1)).alias("links"))
    people = found.agg(F.count(F.lit(1)).alias("people"), F.count_if(F.col("sent_idx").isNull()).alias("links_outside_sentence"))
    return every.crossJoin(people).select((F.col("links") - F.col("people")).alias("non_person_links"), "links_outside_sentence")  # one row each


def subject_mentions(documents: DataFrame) -> DataFrame:
    """One mention without a place for the person each document is about: its qid, else its id."""
    null = lambda kind: F.lit(None).cast(kind)
    subject = F.coalesce(F.nullif(F.col("qid"), F.lit("")), F.col("doc_id").cast("string"))
    return documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(":subject")).alias("mention_id"), "doc_id", null("int").alias("section_idx"), null("int").alias("sent_idx"), null("int").alias("start"), null("int").alias("end"), F.col("title").alias("surface"), subject.alias("entity_id"), F.lit("subject").alias("mention_type"), F.lit("subject").alias("link_method"), F.lit(1.0).alias("confidence"), F.col("title").alias("name"))


def with_people(links: DataFrame, subjects: DataFrame) -> DataFrame:
    """Link mentions with their document's subject and the number of people in the sentence, the subject always among them.

    Distinct people are counted by the last rank of a window, so a sentence streams through and is never gathered.
    """
    known = links.join(subjects.select("doc_id", F.col("entity_id").alias("subject_id")), "doc_id", "left")
    ranked = known.withColumn("_rank", F.dense_rank().over(W.partitionBy(*SENTENCE).orderBy("entity_id")))
    whole = W.partitionBy(*SENTENCE)
    subject, held = F.max("subject_id").over(whole), F.coalesce(F.max((F.col("entity_id") == F.col("subject_id")).cast("int")).over(whole), F.lit(0))
    linked = F.max(F.when(F.col("entity_id").isNotNull(), F.col("_rank"))).over(whole) - F.max(F.col("entity_id").isNull().cast("int")).over(whole)
    counted = ranked.withColumn("linked", F.coalesce(linked, F.lit(0)).cast("bigint")).withColumn("_more", F.when(subject.isNotNull() & (held == 0), 1).otherwise(0))
    return counted.withColumn("people_in_sentence", (F.col("linked") + F.col("_more")).cast("int")).drop("_rank", "_more")


def candidate_pairs(people: DataFrame, most_people: int = MOST_PEOPLE) -> DataFrame:
    """Pairs of mentions within a sentence: the subject with each linked person, and linked people with each other.

    `people` comes from `with_people`, with a unique `start` in its section. Pairs are per mention: a person linked
    twice gives two rows. Sentences with more than `most_people` people give no pairs of linked people;
    they are dropped before the self-join, which bounds it.
    """
    one = people.where(F.col("entity_id") != F.col("subject_id"))
    common = [*SENTENCE, "people_in_sentence"]
    first = one.select(*common, F.col("subject_id").alias("head_entity_id"), F.col("entity_id").alias("tail_entity_id"), F.lit(None).cast("int").alias("head_start"), F.col("start").alias("tail_start"), F.lit("subject_link").alias("rule"))
    small = people.where(F.col("people_in_sentence") <= most_people)
    a = small.select(*common, F.col("entity_id").alias("head_entity_id"), F.col("start").alias("head_start"))
    b = small.select(*SENTENCE, F.col("entity_id").alias("tail_entity_id"), F.col("start").alias("tail_start"))
    second = a.join(b, SENTENCE).where("head_start < tail_start AND head_entity_id <> tail_entity_id").select(*common, "head_entity_id", "tail_entity_id", "head_start", "tail_start", F.lit("link_link").alias("rule"))
    pairs = first.unionByName(second)
    return pairs.withColumn("candidate_id", F.concat_ws(":", *[F.col(c).cast("string") for c in [*SENTENCE, "head_entity_id", "tail_entity_id"]]))


def suppressed(people: DataFrame, most_people: int = MOST_PEOPLE) -> DataFrame:
    """(doc_id, pairs): pairs of distinct linked people that the cap left out."""
    over = people.where(F.col("people_in_sentence") > most_people).select(*SENTENCE, "linked").distinct()
    return over.groupBy("doc_id").agg(F.sum(F.col("linked") * (F.col("linked") - 1) / 2).cast("bigint").alias("pairs"))


def without_pairs(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """Ids of documents that gave no pair."""
    return documents.select("doc_id").join(candidates.select("doc_id").distinct(), "doc_id", "left_anti")


def roll_up(mentions: DataFrame, seed: DataFrame, most_docs: int = 50) -> DataFrame:
    """(entity_id, canonical_name, in_seed, mention_count, doc_count, doc_ids) of every entity.

    The name is the `name` of the first mention by (doc_id, place), a subject before the links of its document:
    a subject's title and a link's resolved title; the surface stands in where mentions have no `name`.
    The window's limit keeps the first `most_docs` ids in each task before the exchange, and the counts are
    added up in part, so an entity with a third of all rows is no hot group.
    """
    place = F.struct("doc_id", F.coalesce("section_idx", F.lit(-1)), F.coalesce("start", F.lit(-1)))
    name = "name" if "name" in mentions.columns else "surface"
    counts = mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("mention_count"), F.min_by(name, place).alias("canonical_name"))
    docs = mentions.select("entity_id", "doc_id").distinct()
    doc_counts = docs.groupBy("entity_id").agg(F.count(F.lit(1)).alias("doc_count"))
    order = W.partitionBy("entity_id").orderBy("doc_id")
    few = docs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most_docs).groupBy("entity_id").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))
    joined = counts.join(doc_counts, "entity_id").join(few, "entity_id").join(seed.select(F.col("qid").alias("entity_id"), F.lit(True).alias("_in")).distinct(), "entity_id", "left")
    return joined.select("entity_id", "canonical_name", F.coalesce("_in", F.lit(False)).alias("in_seed"), "mention_count", "doc_count", "doc_ids")


def mention_counts(mentions: DataFrame) -> DataFrame:
    """Mentions by type and method, with the documents and entities that have them."""
    return mentions.groupBy("mention_type", "link_method").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("entity_id").alias("entities"))
