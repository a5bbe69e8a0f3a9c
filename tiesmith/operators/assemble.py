"""Relation records: a pair's attributes, how much of its sentence they cover, and what they miss."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiesmith.functions.spans import field, owners, runs

LEAST_COVERAGE, BRIDGE = 0.5, 2
ATTRIBUTE = "array<struct<attr_type:string,value:string,span:struct<start:int,end:int>,source:string>>"
SPANS = "array<struct<start:int,end:int>>"


PARTS = "array<struct<start:int,end:int,content:boolean>>"


def tokens(text: Column, stop: Column) -> Column:
    """array<struct<start,end,content>>: parts between blanks; content unless it is a stop word or without letter and digit."""

    @F.arrow_udf(PARTS)
    def run(texts: pa.Array, stops: pa.Array) -> pa.Array:
        sets: dict[tuple, set] = {}
        sizes, rows = [], ([], [], [])
        for t, given in zip(texts.to_pylist(), stops.to_pylist()):
            words = sets.setdefault(tuple(given or ()), set(given or ()))
            at = n = 0
            for part in (t or "").split(" "):
                if part:
                    for column, value in zip(rows, (at, at + len(part), any(map(str.isalnum, part)) and part.lower() not in words)):
                        column.append(value)
                    n += 1
                at += len(part) + 1
            sizes.append(n)
        found = pa.StructArray.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.bool_())], ["start", "end", "content"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), found)

    return run(text, stop)


def content(parsed: Column) -> Column:
    """Tokens of an annotation as array<struct<start,end,content>>, blanks left out."""
    kept = F.filter(parsed, lambda t: ~t["is_space"])
    return F.transform(kept, lambda t: F.struct(t["idx"].alias("start"), (t["idx"] + F.length(t["text"])).alias("end"), (~t["is_stop"] & ~t["is_punct"]).alias("content")))


def _covered(parts: pa.ListArray, spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, content, covered) of each token: covered if it starts in a span of its row. Sorted spans are searched, all rows at once."""
    row, base = owners(parts), np.int64(1) << 32
    whose, start, end = owners(spans), field(spans, "start"), field(spans, "end")
    good = ~(np.isnan(start.astype(float)) | np.isnan(end.astype(float)))
    begins, ends = whose[good] * base + start[good].astype(np.int64), whose[good] * base + end[good].astype(np.int64)
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    place = row * base + field(parts, "start").astype(np.int64)
    at = np.searchsorted(begins, place, "right") - 1
    covered = (at >= 0) & (ends[np.maximum(at, 0)] > place) if len(ends) else np.zeros(len(row), bool)
    return row, field(parts, "content").astype(bool), covered


def coverage(parts: Column, spans: Column) -> Column:
    """Share of content tokens that start in a span; 1.0 if there are none."""

    @F.arrow_udf("double")
    def run(parts: pa.Array, spans: pa.Array) -> pa.Array:
        row, content, covered = _covered(parts, spans)
        every, held = (np.bincount(row[x], minlength=len(parts)) for x in (content, content & covered))
        return pa.array(np.where(every > 0, held / np.maximum(every, 1), 1.0))

    return run(parts, spans)


def uncovered(text: Column, parts: Column, spans: Column, bridge: int = BRIDGE) -> Column:
    """Texts of the runs of content tokens outside all spans, bridged over at most `bridge` other tokens."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array, parts: pa.Array, spans: pa.Array) -> pa.Array:
        row, content, covered = _covered(parts, spans)
        first, last = runs(row, content & ~covered, bridge)
        start, end, held = field(parts, "start"), field(parts, "end"), texts.to_pylist()
        out: list[list[str]] = [[] for _ in held]
        for r, s, e in zip(row[first].tolist(), start[first].tolist(), end[last].tolist()):
            out[r].append((held[r] or "")[int(s) : int(e)])
        return pa.array(out, pa.list_(pa.string()))

    return run(text, parts, spans)


def gathered(spans: DataFrame, key: str) -> DataFrame:
    """(key, attributes): spans of a sentence or pair as one array in order of place and type."""
    item = F.struct(F.coalesce(F.col("span.start"), F.lit(-1)).alias("at"), "attr_type", "value", "span", F.col("detector").alias("source"))
    return spans.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda a: F.struct(a["attr_type"].alias("attr_type"), a["value"].alias("value"), a["span"].alias("span"), a["source"].alias("source"))).alias("attributes"))


def relations(located: DataFrame, spans: DataFrame, annotated: DataFrame | None, stop: list[str] | None = None) -> DataFrame:
    """relations of candidates with `head` and `tail` (see `with_participants`).

    Sentence spans (candidate_id null) come before those of the pair; a repeated candidate_id gives each of its
    rows all spans of that id. Without annotations the sentence is tokenised at blanks with the `stop` words.
    """
    sentence = gathered(spans.where("candidate_id IS NULL"), "sentence_id").withColumnRenamed("attributes", "_s")
    pair = gathered(spans.where("candidate_id IS NOT NULL"), "candidate_id").withColumnRenamed("attributes", "_c")
    joined = located.join(sentence, "sentence_id", "left").join(pair, "candidate_id", "left")
    if annotated is not None:
        joined = joined.join(annotated.select("sentence_id", content(F.col("tokens")).alias("_t")), "sentence_id", "left")
    else:
        joined = joined.withColumn("_t", tokens(F.col("sentence"), F.array(*[F.lit(w) for w in stop or []]).cast("array<string>")))
    empty = F.array().cast(ATTRIBUTE)
    joined = joined.withColumn("attributes", F.concat(F.coalesce("_s", empty), F.coalesce("_c", empty))).withColumn("_t", F.coalesce("_t", F.array().cast(PARTS)))
    place = lambda p: F.when(F.col(p).isNotNull(), F.array(F.struct(F.col(f"{p}.start").alias("start"), F.col(f"{p}.end").alias("end")))).otherwise(F.array()).cast(SPANS)
    held = F.concat(F.filter(F.transform("attributes", lambda a: a["span"]), lambda s: s.isNotNull()).cast(SPANS), place("head"), place("tail"))
    joined = joined.withColumn("_spans", held)
    pronoun = F.coalesce(F.col("head.method") == "pronoun", F.lit(False)) | F.coalesce(F.col("tail.method") == "pronoun", F.lit(False))
    who = lambda c: F.struct(F.col(c).alias("mention_id"), F.col(c).alias("qid"))
    return joined.select(
        F.col("candidate_id").alias("relation_id"), "sentence_id", "sentence", F.array(who("head_entity_id"), who("tail_entity_id")).alias("participants"), "attributes",
        F.round(coverage(F.col("_t"), F.col("_spans")), 4).alias("coverage"), uncovered(F.col("sentence"), F.col("_t"), F.col("_spans")).alias("uncovered"), pronoun.alias("pronoun_resolved"),
    )


def split_by_coverage(records: DataFrame, least: float = LEAST_COVERAGE) -> tuple[DataFrame, DataFrame]:
    """(kept, low): records by their rounded coverage."""
    return records.where(F.col("coverage") >= least), records.where(F.col("coverage") < least)


def coverage_counts(records: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    n = F.count(F.lit(1))
    share = lambda c: F.when(n > 0, F.round(F.count_if(c) / n, 4)).otherwise(0.0)
    return records.agg(n.alias("records"), F.count_if(F.col("coverage") < least).alias("low"), share(F.col("coverage") < least).alias("low_rate"), F.round(F.coalesce(F.avg("coverage"), F.lit(0.0)), 4).alias("mean_coverage"), share(F.col("pronoun_resolved")).alias("pronoun_rate"))


def rendered(records: DataFrame) -> DataFrame:
    """(relation_id, block): a record as lines of text."""
    who = F.array_join(F.transform("participants", lambda p: F.coalesce(p["qid"], F.lit("?"))), " -- ")
    what = F.array_join(F.transform("attributes", lambda a: F.concat(F.lit("  "), a["attr_type"], F.lit(": "), F.coalesce(a["value"], F.lit("")))), "\n")
    missed = F.when(F.size("uncovered") > 0, F.concat(F.lit("  uncovered: "), F.array_join("uncovered", " | ")))
    head = F.concat(who, F.lit("  ("), F.format_string("%.4f", F.col("coverage")), F.when(F.col("pronoun_resolved"), ", by pronoun").otherwise(""), F.lit(")"))
    return records.select("relation_id", F.concat_ws("\n", head, F.concat(F.lit("  "), F.col("sentence")), F.when(what != "", what), missed).alias("block"))
