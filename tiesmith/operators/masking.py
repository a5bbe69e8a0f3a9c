"""Distinct sentences of candidate pairs, and their wording without names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiesmith.functions.spans import PLACEHOLDER, mask
from tiesmith.functions.text import name_variants

SENTENCE = ["doc_id", "section_idx", "sent_idx"]


def distinct_sentences(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """One row for each sentence in the order of its numeric key; `limit` keeps the first (0: none, None: all)."""
    once = candidates.groupBy(*SENTENCE).agg(F.min("sentence").alias("sentence"))
    keyed = once.withColumn("sentence_id", F.concat_ws(":", *[F.col(c).cast("string") for c in SENTENCE]))
    return keyed if limit is None else keyed.orderBy(*SENTENCE).limit(limit)


def people_spans(mentions: DataFrame, starts: DataFrame) -> DataFrame:
    """(sentence_id, spans): sentence-local spans of linked people; mentions of unknown sentences are left out."""
    links = mentions.where("mention_type = 'link'").withColumn("sentence_id", F.concat_ws(":", *[F.col(c).cast("string") for c in SENTENCE]))
    base = starts.groupBy("sentence_id").agg(F.min("start").alias("_base"))
    local = links.join(base, "sentence_id").select("sentence_id", F.struct((F.col("start") - F.col("_base")).cast("int").alias("start"), (F.col("end") - F.col("_base")).cast("int").alias("end")).alias("span"))
    return local.groupBy("sentence_id").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def subject_names(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, names): ways the person a document is about is named; the surface where the entity has no name."""
    named = entities.groupBy("qid").agg(F.max("canonical_name").alias("_name"))
    subjects = mentions.where("mention_type = 'subject'").join(named, F.col("entity_id") == F.col("qid"), "left")
    return subjects.groupBy("doc_id").agg(F.max(F.coalesce("_name", "surface")).alias("_n")).select("doc_id", name_variants("_n").alias("names"))


def masked(sentences: DataFrame, spans: DataFrame, names: DataFrame, placeholder: str = PLACEHOLDER) -> DataFrame:
    """Sentences with `masked_sentence`; the wording itself stays in `sentence`."""
    joined = sentences.join(spans, "sentence_id", "left").join(names, "doc_id", "left")
    return joined.withColumn("masked_sentence", mask(F.col("sentence"), F.col("spans"), F.col("names"), placeholder)).drop("spans", "names")
