"""One row a person from query results with several, and counts of what they lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill_gaps(rows: DataFrame, key: str, order: list[str], once: list[str], fields: list[str]) -> DataFrame:
    """One row for each key: `once` from its first row, each of `fields` from the first row that has it.

    `variants` counts the rows beyond the first. `order` has to be unique within a key; rows without key are dropped.
    """
    at = F.struct(*[F.col(c) for c in order])
    firsts = [F.min_by(F.col(c), at).alias(c) for c in once]
    given = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in fields]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*firsts, *given, (F.count(F.lit(1)) - 1).alias("variants"))


def seed_quality(seed: DataFrame) -> DataFrame:
    """How many people there are and how many lack a year or gender or had several rows."""
    lacks = [F.count_if(F.col(c).isNull()).alias(f"without_{c}") for c in ("birth_year", "death_year", "gender")]
    return seed.agg(F.count(F.lit(1)).alias("people"), *lacks, F.count_if(F.col("variants") > 0).alias("with_variants"))


def collapse_metadata(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row an item: first given years and gender, and its occupations sorted, empty if it has none."""
    at = F.struct(*[F.col(c) for c in order])
    given = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in ("birth_year", "death_year", "gender")]
    return rows.where("qid IS NOT NULL").groupBy("qid").agg(*given, F.array_sort(F.collect_set("occupation")).alias("occupations"))


def descendants(edges: DataFrame, root: str, most_rounds: int = 50) -> DataFrame:
    """(item): the root and everything below it by (child, parent) edges, cycles included once.

    Breadth-first: each round joins the edges with what the last one found and cuts the lineage.
    """
    from tiesmith.session import durable

    known = durable(edges.sparkSession.createDataFrame([(root,)], "item string"))
    fresh = known
    for _ in range(most_rounds):
        below = edges.join(fresh.withColumnRenamed("item", "parent"), "parent").select(F.col("child").alias("item")).distinct()
        fresh = durable(below.join(known, "item", "left_anti"))
        if fresh.isEmpty():
            return known
        known = durable(known.unionByName(fresh))
    raise ValueError(f"the hierarchy below {root} is deeper than {most_rounds}")


def corpus_counts(people: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """One row: distinct people (qid, occupation) of the class itself, and of it with its subclasses."""
    below = descendants(edges, root)
    strict = people.where(F.col("occupation") == root).agg(F.countDistinct("qid").alias("strict"))
    whole = people.join(below, F.col("occupation") == F.col("item"), "left_semi").agg(F.countDistinct("qid").alias("with_subclasses"))
    return strict.crossJoin(whole)  # one row each
