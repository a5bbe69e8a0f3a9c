"""Expressions over statement lists array<struct<rank,value_id,value_time>> and a hash of settings."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layout of one property's statements as the knowledge base serves them.
CLAIMS = "array<struct<rank:string,mainsnak:struct<datavalue:struct<value:struct<id:string,time:string>>>>>"


def best_rank(claims: Column) -> Column:
    """Preferred statements if there are any, else all that aren't deprecated."""
    usable = F.filter(claims, lambda c: F.coalesce(c["rank"], F.lit("normal")) != "deprecated")
    preferred = F.filter(usable, lambda c: c["rank"] == "preferred")
    return F.when(F.size(preferred) > 0, preferred).otherwise(usable)


def claim_ids(claims: Column) -> Column:
    """Distinct items that the best statements name; statements without a value don't count."""
    ids = F.transform(best_rank(claims), lambda c: c["mainsnak"]["datavalue"]["value"]["id"])
    return F.array_distinct(F.filter(ids, lambda i: i.isNotNull()))


def claim_year(claims: Column) -> Column:
    """Year of the first best statement that has one; years before the era are negative."""
    pattern = r"^([+-]?)(\d+)-"
    times = F.transform(best_rank(claims), lambda c: c["mainsnak"]["datavalue"]["value"]["time"])
    found = F.filter(times, lambda t: t.isNotNull() & t.rlike(pattern))
    first = F.get(found, F.lit(0))
    year = F.regexp_extract(first, pattern, 2).try_cast("int")
    return F.when(first.isNotNull(), F.when(F.regexp_extract(first, pattern, 1) == "-", -year).otherwise(year))


def run_id(config: dict) -> str:
    """Twelve hexadecimal digits that depend on the settings only."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]
