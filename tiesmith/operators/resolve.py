"""Link targets resolved to people: frequencies, aliases, three-valued answers, cache guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class IncompleteCache(ValueError):
    """The cache lacks answers that a strict run needs."""


def exploded_links(documents: DataFrame) -> DataFrame:
    """(doc_id, section_idx, link_idx, start, end, surface, target_title) of documents with sections."""
    sections = documents.select("doc_id", F.posexplode("sections").alias("section_idx", "section"))
    links = sections.select("doc_id", "section_idx", F.posexplode("section.links").alias("link_idx", "link"))
    return links.select("doc_id", "section_idx", "link_idx", "link.*")


def target_frequency(links: DataFrame, order: list[str]) -> DataFrame:
    """(target_title, n, first) by falling frequency; ties go to the title seen first."""
    first = F.min(F.struct(*[F.col(c) for c in order])).alias("first")
    return links.where("target_title IS NOT NULL").groupBy("target_title").agg(F.count(F.lit(1)).alias("n"), first).orderBy(F.desc("n"), "first")


def chase_aliases(titles: DataFrame, aliases: DataFrame, hops: int = 4) -> DataFrame:
    """(title, resolved_title) after at most `hops` steps through (source, target); a later row overrides an earlier one."""
    known = aliases.groupBy("source").agg(F.max_by("target", "ord").alias("target"))
    out = titles.select("title", F.col("title").alias("resolved_title"))
    for hop in range(hops):
        step = known.select(F.col("source").alias(f"s{hop}"), F.col("target").alias(f"t{hop}"))
        out = out.join(step, F.col("resolved_title") == F.col(f"s{hop}"), "left")
        out = out.select("title", F.coalesce(f"t{hop}", "resolved_title").alias("resolved_title"))
    return out


def most_frequent(frequency: DataFrame, limit: int | None) -> DataFrame:
    """(title, link_instances) of the rows of `target_frequency`; `limit` keeps the most frequent (0: none, None: all)."""
    kept = frequency if limit is None else frequency.orderBy(F.desc("n"), "first").limit(limit)
    return kept.select(F.col("target_title").alias("title"), F.col("n").alias("link_instances"))


def items_of_titles(titles: DataFrame, steps: DataFrame) -> DataFrame:
    """(title, resolved_title, qid) of titles through the steps that a server took: (kind, source, target).

    `normalized` and `redirects` steps lead on, a redirect before a normalisation of the same title; `item` gives a title's item.
    """
    order = F.when(F.col("kind") == "redirects", 1).otherwise(0).alias("ord")
    chased = chase_aliases(titles, steps.where("kind <> 'item'").select("source", "target", order))
    items = steps.where("kind = 'item'").groupBy(F.col("source").alias("resolved_title")).agg(F.max("target").alias("qid"))
    return chased.join(items, "resolved_title", "left").select("title", "resolved_title", "qid")


def resolve_titles(titles: DataFrame, cache: DataFrame, claims: DataFrame) -> DataFrame:
    """Titles of the title cache with their claims.

    `is_human` has three values: false where there is no item, the claims' answer where there are
    claims, null where they are still unknown.
    """
    known = titles.join(cache, "title").join(claims.withColumn("_found", F.lit(True)), "qid", "left")
    human = F.when(F.col("qid").isNull(), F.lit(False)).when(F.col("_found"), F.col("is_human"))
    return known.withColumn("no_item", F.col("qid").isNull()).withColumn("claims_resolved", F.col("qid").isNull() | F.col("_found").isNotNull()).withColumn("is_human", human).drop("_found")


def resolve_counts(resolved: DataFrame) -> DataFrame:
    """How many titles and link instances lead to people, to others, to nothing yet."""
    instances = F.coalesce(F.sum("link_instances"), F.lit(0))
    human = F.coalesce(F.sum(F.when(F.col("is_human"), F.col("link_instances"))), F.lit(0))
    return resolved.agg(
        F.count(F.lit(1)).alias("titles"), F.count_if("is_human").alias("human_titles"), F.count_if(F.col("is_human").isNull()).alias("unknown_titles"),
        F.count_if("no_item").alias("red_titles"), instances.alias("link_instances"), human.alias("human_instances"),
        F.when(instances > 0, F.round(human / instances, 4)).otherwise(0.0).alias("human_rate"),
    )


def cache_coverage(targets: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: link targets, those the cache lacks, those whose claims are still open. Old rows without the flag count as resolved."""
    wanted = targets.select("title").distinct()
    held = cache.groupBy("title").agg(F.max(F.coalesce("claims_resolved", F.lit(True))).alias("resolved"))
    both = wanted.join(held, "title", "left")
    return both.agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("resolved").isNull()).alias("absent"), F.count_if(F.col("resolved") == F.lit(False)).alias("open"))


def require_coverage(targets: DataFrame, cache: DataFrame, strict: bool = True) -> dict:
    """The coverage; in strict mode an error where anything is absent or open."""
    row = cache_coverage(targets, cache).first().asDict()
    if strict and (row["absent"] or row["open"]):
        raise IncompleteCache(f"{row['absent']} of {row['targets']} link targets are absent from the cache, {row['open']} have open claims")
    return row


def human_index(cache: DataFrame) -> DataFrame:
    """(title, ...) of the cache rows that are people with an item; the last row of a title wins by `ord` if there is one."""
    people = cache.where("is_human AND qid IS NOT NULL AND qid <> ''")
    # Without an order the greatest row wins, so that the answer doesn't depend on how the cache is read.
    order = F.col("ord") if "ord" in cache.columns else F.struct("qid", F.to_json(F.struct("*")))
    last = F.max_by(F.struct(*[F.col(c) for c in people.columns]), order)
    return people.groupBy("title").agg(last.alias("r")).select("r.*")
