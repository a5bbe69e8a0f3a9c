"""Occurrences and presence of every distinct term of a collection (problem 4).

1. Each task counts the terms of its own stretches of records, so a hot term crosses the network
   once a stretch, however often it occurs.
2. A global dictionary numbers the distinct terms in order: range-sorted parts, each with the
   number of terms before it.
3. The stretches' counts are encoded with those numbers and become blockwise arrays: for each block of
   65,536 identifiers the offsets and both counts.
4. The arrays are exchanged by block and summed into one pair of dense arrays at a time; the block's stretch
   of the dictionary follows them and gives the counts their terms.

Defined cases: null and blank terms don't count; a record without terms counts only towards the
number of records; a repeated row is a record of its own, as the caller dedups; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiesmith.session import durable

BLOCK_BITS = 16
#: Distinct terms a task keeps before it hands its counts on.
HELD = 200_000
_HOST = re.compile(r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]+/(?:wiki/)?|\./)")


def article_title(title: str | None) -> str | None:
    """Display form of an article title, however it is addressed; None if nothing is left.

    Character references and percent codes are decoded, host, query and fragment dropped,
    underscores and runs of blanks become one blank, the form is NFC with a capital first letter.
    """
    if not title:
        return None
    if "&" in title:
        title = html.unescape(title)
    title = _HOST.sub("", title.strip()).partition("#")[0].partition("?")[0]
    if "%" in title:
        title = unquote(title)
    title = " ".join(title.replace("_", " ").split())
    if not title.isascii():
        title = unicodedata.normalize("NFC", title)
    first = title[:1].upper()
    return (first if len(first) == 1 else title[:1]) + title[1:] or None


def _partial(rows: DataFrame, normal: Callable[[str | None], str | None]) -> DataFrame:
    """(term, occurrences, records) of each stretch of each task; rows has one array column `terms`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurs, present, forms = Counter(), Counter(), {}

        def give() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(occurs), pa.string()), pa.array(list(occurs.values()), pa.int64()), pa.array([present[t] for t in occurs], pa.int64())], ["term", "occurrences", "records"])
            occurs.clear(), present.clear(), forms.clear()
            return out

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                found = []
                for t in raw or ():
                    if t not in forms:
                        forms[t] = normal(t)
                    if forms[t] is not None:
                        found.append(forms[t])
                occurs.update(found)
                present.update(set(found))
                if len(forms) > HELD:
                    yield give()
        yield give()

    return rows.mapInArrow(scan, "term string, occurrences bigint, records bigint")


def dictionary(terms: DataFrame) -> DataFrame:
    """(term, term_id): the distinct values of `terms.term`, numbered from 0 in binary order."""
    spark = terms.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = terms.select("term").repartitionByRange(parts, "term").sortWithinPartitions("term")
    # The parts are written once: ranges come from a sample, and a lost part must not change the numbers.
    kept = durable(ranged.select("term", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("row")))
    sizes = {r.part: r.n for r in kept.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a part
    order = sorted(sizes)
    bases = spark.createDataFrame([*zip(order, accumulate((sizes[p] for p in order), initial=0))], "part int, base bigint")
    return kept.join(F.broadcast(bases), "part").select("term", (F.col("row") + F.col("base")).alias("term_id"))


_BLOCKS = "block bigint, named boolean, offsets array<int>, occurrences array<bigint>, records array<bigint>, terms array<string>"


def _folded(ids: np.ndarray, bits: int, named: bool, columns: list[pa.Array | None]) -> pa.RecordBatch:
    """One row a block of identifiers, whose lists are the offsets within the block and the columns' values."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    blocks, first = np.unique(ids >> bits, return_index=True)
    cuts = pa.array(np.r_[first, len(ids)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(cuts, pa.array((ids & ((1 << bits) - 1)).astype(np.int32)))]
    for column, kind in zip(columns, (pa.int64(), pa.int64(), pa.string())):
        lists.append(pa.nulls(len(blocks), pa.list_(kind)) if column is None else pa.ListArray.from_arrays(cuts, column.take(pa.array(order))))
    return pa.record_batch([pa.array(blocks, pa.int64()), pa.array(np.full(len(blocks), named)), *lists], ["block", "named", "offsets", "occurrences", "records", "terms"])


def _summed(encoded: DataFrame, numbered: DataFrame) -> DataFrame:
    """(term_id, term, occurrences, records): arrays summed by identifier range."""
    bits = BLOCK_BITS

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _folded(batch.column(0).to_numpy(), bits, False, [batch.column(1), batch.column(2), None])

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _folded(batch.column(0).to_numpy(), bits, True, [None, None, batch.column(1)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One block at a time, as the rows come sorted by block and the names after the counts."""
        block, sums = None, np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for b, named, offsets, occurs, present, terms in zip(*batch.columns):
                if (b := b.as_py()) != block:
                    block = b
                    sums[:] = 0
                at = offsets.values.to_numpy()
                if named.as_py():
                    yield pa.record_batch([pa.array(at + (block << bits), pa.int64()), terms.values, pa.array(sums[0][at]), pa.array(sums[1][at])], ["term_id", "term", "occurrences", "records"])
                else:
                    np.add.at(sums[0], at, occurs.values.to_numpy())
                    np.add.at(sums[1], at, present.values.to_numpy())

    arrays = encoded.select("term_id", "occurrences", "records").mapInArrow(counts, _BLOCKS).unionByName(numbered.select("term_id", "term").mapInArrow(names, _BLOCKS))
    return arrays.repartition("block").sortWithinPartitions("block", "named").mapInArrow(add, "term_id bigint, term string, occurrences bigint, records bigint")


def term_frequency(rows: DataFrame, terms: str, least_records: int = 2, most_share: float = 0.05, normal: Callable[[str | None], str | None] = article_title) -> DataFrame:
    """(term_id, term, occurrences, records, mark) of every distinct term of the array column `terms`.

    `records` counts the rows that hold the term. `mark` is `rare` below `least_records` records,
    `common` above `most_share` of all rows, else null.
    """
    total = rows.count()
    partial = durable(_partial(rows.select(F.col(terms).alias("terms")), normal))
    numbered = durable(dictionary(partial.select("term").distinct()))
    counts = _summed(partial.join(numbered, "term"), numbered)
    mark = F.when(F.col("records") < least_records, "rare").when(F.col("records") > most_share * total, "common")
    return counts.select("term_id", "term", "occurrences", "records", mark.alias("mark"))
