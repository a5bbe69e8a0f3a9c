"""Typed spans of sentences: named ones, and the action between two participants."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiesmith.functions.text import name_variants, pronoun_span, word_position

# What the labels of named spans become.
ATTR_TYPES = {"DATE": "time", "GPE": "place", "LOC": "place", "FAC": "place", "ORG": "institution"}
PLACE = "struct<start:int,end:int,method:string>"


def named_spans(annotated: DataFrame) -> DataFrame:
    """(sentence_id, candidate_id null, attr_type, value, span, detector) of the labels that have a type."""
    kinds = F.create_map(*[F.lit(x) for pair in ATTR_TYPES.items() for x in pair])
    flat = annotated.select("sentence_id", F.explode("ents").alias("e")).withColumn("attr_type", F.try_element_at(kinds, F.col("e.label"))).where("attr_type IS NOT NULL")
    return flat.select("sentence_id", F.lit(None).cast("string").alias("candidate_id"), "attr_type", F.col("e.text").alias("value"), F.struct("e.start", "e.end").alias("span"), F.lit("ner").alias("detector"), F.lit(None).cast("boolean").alias("pronoun_resolved"))


def locate_participant(text: Column, span: Column, sentence_start: Column, name: Column, gender: Column) -> Column:
    """struct<start,end,method>: where a participant stands in its sentence.

    A given span decides alone, null if it is out of bounds; without one the name is sought, the longest variant first,
    then a pronoun that fits the gender.
    """
    start, end = span["start"] - sentence_start, span["end"] - sentence_start
    given = F.when((start >= 0) & (start < end) & (end <= F.length(text)), F.struct(start.alias("start"), end.alias("end"), F.lit("span").alias("method")).cast(PLACE))
    found = F.transform(name_variants(name), lambda v: F.struct(word_position(text, v).alias("start"), F.length(v).alias("n")))
    hit = F.get(F.filter(found, lambda f: f["start"] >= 0), F.lit(0))
    named = F.when(hit.isNotNull(), F.struct(hit["start"].alias("start"), (hit["start"] + hit["n"]).alias("end"), F.lit("name").alias("method")).cast(PLACE))
    pronoun = pronoun_span(text, gender)
    spoken = F.when(pronoun.isNotNull(), F.struct(pronoun["start"].alias("start"), pronoun["end"].alias("end"), F.lit("pronoun").alias("method")).cast(PLACE))
    return F.when(span.isNotNull(), given).otherwise(F.coalesce(named, spoken))


def _chain(heads: list[int], at: int) -> list[int]:
    """Token numbers from `at` up to the root; a circle is gone round once."""
    out: dict[int, None] = {}
    while at is not None and 0 <= at < len(heads) and at not in out:
        out[at] = None
        at = heads[at]
    return list(out)


def _depth(heads: list[int], at: int, depths: dict[int, int]) -> int:
    """Tokens from `at` to the root, both counted; what is known already is not walked again."""
    walked: dict[int, None] = {}
    while at is not None and 0 <= at < len(heads) and at not in walked and at not in depths:
        walked[at] = None
        at = heads[at]
    under = 0 if at in walked else depths.get(at, 0)
    for k, x in enumerate(reversed(walked), 1):
        depths[x] = under + k
    return under + len(walked)


def _root(tree: list[dict], start: int | None, end: int | None, depths: dict[int, int]) -> int | None:
    """Number of the token of a span nearest to the root, the lowest of equals."""
    if start is None or end is None:
        return None
    heads = [t["head"] for t in tree]
    best = min(((depths[i] if i in depths else _depth(heads, i, depths), i) for i, t in enumerate(tree) if t["start"] < end and t["end"] > start), default=None)
    return best and best[1]


def _path(tree: list[dict], head: int | None, tail: int | None) -> dict | None:
    """From the leftmost to the rightmost token on the path between two tokens; None if their chains never meet."""
    if head is None or tail is None:
        return None
    heads = [t["head"] for t in tree]
    a, b = _chain(heads, head), _chain(heads, tail)
    above = {x: k for k, x in enumerate(b)}
    k = next((k for k, x in enumerate(a) if x in above), None)
    if k is None:
        return None
    on = [tree[x] for x in [*a[: k + 1], *b[: above[a[k]]]]]
    return {"start": min(t["start"] for t in on), "end": max(t["end"] for t in on)}


SPAN = "struct<start:int,end:int>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def tree(tokens: Column) -> Column:
    """What paths need of annotated tokens: array<struct<start,end,head>>."""
    return F.transform(tokens, lambda t: F.struct(t["idx"].alias("start"), (t["idx"] + F.length(t["text"])).cast("int").alias("end"), t["head"].alias("head")))


def span_root(tokens: Column, start: Column, end: Column) -> Column:
    """Number of the token of a span nearest to the root of the sentence, the lowest of equals; null if none touches it."""

    @F.arrow_udf("int")
    def run(trees: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        return pa.array([_root(t or [], s, e, {}) for t, s, e in zip(trees.to_pylist(), starts.to_pylist(), ends.to_pylist())], pa.int32())

    return run(tree(tokens), start, end)


def path_span(tokens: Column, head: Column, tail: Column) -> Column:
    """struct<start,end>: from the leftmost to the rightmost token on the path between two participants' roots.

    `head` and `tail` are token numbers; null where a participant has none or their chains never meet.
    """

    @F.arrow_udf(SPAN)
    def run(trees: pa.Array, heads: pa.Array, tails: pa.Array) -> pa.Array:
        return pa.array([_path(t or [], h, o) for t, h, o in zip(trees.to_pylist(), heads.to_pylist(), tails.to_pylist())], _SPAN)

    return run(tree(tokens), head, tail)


def between(tokens: Column, head: Column, tail: Column) -> Column:
    """struct<start,end> of the path between the roots of two spans in one pass over the tokens."""

    @F.arrow_udf(SPAN)
    def run(trees: pa.Array, *places: pa.Array) -> pa.Array:
        out = []
        for t, a, b, c, d in zip(trees.to_pylist(), *(p.to_pylist() for p in places)):
            depths: dict[int, int] = {}
            out.append(_path(t or [], _root(t or [], a, b, depths), _root(t or [], c, d, depths)))
        return pa.array(out, _SPAN)

    return run(tree(tokens), head["start"], head["end"], tail["start"], tail["end"])


def with_participants(candidates: DataFrame, entities: DataFrame, sentences: DataFrame) -> DataFrame:
    """Candidates with `head` and `tail` located in their sentence.

    candidates: candidate_id, sentence_id, sentence, head_entity_id, tail_entity_id, head_span, tail_span; entities: qid,
    canonical_name, gender; sentences: sentence_id, start. A missing sentence counts as starting at 0.
    """
    starts = sentences.groupBy("sentence_id").agg(F.min("start").alias("_start"))
    people = entities.groupBy("qid").agg(F.max(F.struct("canonical_name", "gender")).alias("p")).select("qid", "p.*")
    head = people.select(F.col("qid").alias("head_entity_id"), F.col("canonical_name").alias("_hn"), F.col("gender").alias("_hg"))
    tail = people.select(F.col("qid").alias("tail_entity_id"), F.col("canonical_name").alias("_tn"), F.col("gender").alias("_tg"))
    joined = candidates.join(starts, "sentence_id", "left").join(head, "head_entity_id", "left").join(tail, "tail_entity_id", "left")
    base = F.coalesce("_start", F.lit(0))
    located = joined.withColumn("head", locate_participant(F.col("sentence"), F.col("head_span"), base, F.col("_hn"), F.col("_hg"))).withColumn("tail", locate_participant(F.col("sentence"), F.col("tail_span"), base, F.col("_tn"), F.col("_tg")))
    return located.drop("_start", "_hn", "_hg", "_tn", "_tg")


def action_spans(located: DataFrame, annotated: DataFrame) -> DataFrame:
    """Action rows of candidates whose participants and path are found; candidates without annotated sentence are skipped."""
    both = located.join(annotated.select("sentence_id", "tokens"), "sentence_id").where("head IS NOT NULL AND tail IS NOT NULL")
    spans = both.withColumn("span", between(F.col("tokens"), F.col("head"), F.col("tail"))).where("span IS NOT NULL")
    value = F.substring(F.col("sentence"), F.col("span.start") + 1, F.col("span.end") - F.col("span.start"))
    pronoun = (F.col("head.method") == "pronoun") | (F.col("tail.method") == "pronoun")
    return spans.select("sentence_id", "candidate_id", F.lit("action").alias("attr_type"), value.alias("value"), "span", F.lit("dependency").alias("detector"), pronoun.alias("pronoun_resolved"))


def attribute_counts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("attr_type").agg(F.count(F.lit(1)).alias("spans"))


def action_rates(located: DataFrame, actions: DataFrame) -> DataFrame:
    """Candidates, those with an action and those that rest on a pronoun; shares to four places, 0.0 of nothing."""
    held = located.join(actions.select("candidate_id", F.lit(1).alias("_a")).distinct(), "candidate_id", "left")
    pronoun = F.coalesce(F.col("head.method") == "pronoun", F.lit(False)) | F.coalesce(F.col("tail.method") == "pronoun", F.lit(False))
    n = F.count(F.lit(1))
    share = lambda c: F.when(n > 0, F.round(F.count_if(c) / n, 4)).otherwise(0.0)
    return held.agg(n.alias("candidates"), F.count_if(F.col("_a").isNotNull()).alias("with_action"), share(F.col("_a").isNotNull()).alias("action_rate"), share(pronoun).alias("pronoun_rate"))
