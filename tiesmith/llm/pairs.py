"""Items that occur together, and how much more often than chance (problem 3).

1. Distinct (group, item) rows, and in how many groups each item stands. An item that no pair
   of the asked strength can hold is dropped before any pair is made; the bounds are exact.
2. The remaining items get integer codes, a pair one 64-bit code and, beyond 2^31 items, the page of
   codes it stands on. Groups of more than `block`
   items are cut into hashed blocks whose block pairs are separate rows, so no task holds a
   whole group.
3. Each task sorts its codes in runs and adds equal ones up; the runs are exchanged by code,
   sorted externally (spilled runs, multiway merge) and added up by run length.
4. Counts become odds ratios, with half a case added to each cell (continuity correction).

Defined cases: rows with a null in the group key or item are ignored; repeated rows count
once; an item doesn't pair with itself; other columns are ignored. Ids are in string order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiesmith.llm.terms import dictionary
from tiesmith.session import durable

BLOCK = 64
#: Pair codes in one sorted run of a task.
RUN = 1_000_000


#: Bits of an item's number within a page of codes.
ID_BITS = 31


def _runs(pages: np.ndarray, codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (page, code) of sorted ones with the sums of their counts."""
    if not len(codes):
        return pages, codes, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (pages[1:] != pages[:-1])])
    return pages[first], codes[first], np.diff(np.r_[first, len(codes)]) if counts is None else np.add.reduceat(counts, first)


def _codes(batch: pa.RecordBatch, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pages and codes of the pairs of rows (left items, right items); right is null where a block meets itself."""
    lows, highs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for left, right in zip(batch.column(0), batch.column(1)):
        a = np.sort(left.values.to_numpy())
        if right.is_valid:
            b = right.values.to_numpy()
            x, y = np.repeat(a, len(b)), np.tile(b, len(a))
            lows.append(np.minimum(x, y))
            highs.append(np.maximum(x, y))
        elif len(a) > 1:
            i, j = np.triu_indices(len(a), 1)
            lows.append(a[i])
            highs.append(a[j])
    low, high, mask = np.concatenate(lows), np.concatenate(highs), np.int64((1 << bits) - 1)
    return (low >> bits) << np.int64(32) | (high >> bits), (low & mask) << np.int64(32) | (high & mask)


def _packed(pages: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(pages), pa.array(codes), pa.array(counts, pa.int64())], ["page", "code", "n"])


def _spilled(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def give() -> pa.RecordBatch:
        pages, codes = (np.concatenate(x) for x in zip(*held))
        held.clear()
        if pages.any():
            order = np.lexsort((codes, pages))
            return _packed(*_runs(pages[order], codes[order]))
        return _packed(*_runs(pages, np.sort(codes)))

    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            held.append(_codes(batch.slice(start, 1024), bits))
            size += len(held[-1][1])
            if size > RUN:
                yield give()
                size = 0
    if size:
        yield give()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length sums of codes that come in order; the last code waits for the next batch."""
    last = (np.zeros(0, np.int64),) * 3
    for batch in batches:
        runs = _runs(*(np.concatenate([a, b.to_numpy(zero_copy_only=False)]) for a, b in zip(last, batch.columns)))
        yield _packed(*(x[:-1] for x in runs))
        last = tuple(x[-1:] for x in runs)
    yield _packed(*last)


def together(rows: DataFrame, group: list[str], item: str, least: int = 1, least_lift: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, odds_ratio) of the pairs of items that share groups.

    Only pairs with n_ab >= `least` and n_ab * n >= `least_lift` * n_a * n_b, where n counts the groups.
    """
    key = F.struct(*[F.col(g) for g in group])
    present = [F.col(c).isNotNull() for c in [*group, item]]
    holds = present[0]
    for p in present[1:]:
        holds = holds & p
    held = durable(rows.where(holds).select(F.xxhash64(key).alias("h"), key.alias("g"), F.col(item).cast("string").alias("term")).distinct())
    total = held.select("g").distinct().count()
    single = held.groupBy("term").agg(F.count(F.lit(1)).alias("n_item"))
    # n_ab is at most either count: an item needs `least` groups, and with the rarest partner allowed
    # its lift is at most n / n_item.
    useful = single.where((F.col("n_item") >= least) & (F.col("n_item") * F.lit(float(least_lift)) <= total))
    numbered = durable(dictionary(useful).join(useful, "term"))
    coded = held.join(numbered.select("term", F.col("term_id").alias("id")), "term").select("h", "g", "id")
    sizes = coded.groupBy("h", "g").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = coded.join(sizes, ["h", "g"]).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    mine = F.pmod(F.hash("id"), "blocks")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j")))
    cells = sized.select("h", "g", "id", mine.alias("mine"), F.explode(others).alias("cell")).groupBy("h", "g", "cell")
    side = lambda which: F.collect_list(F.when(F.col("mine") == F.col(f"cell.{which}"), F.col("id")))
    lists = cells.agg(side("i").alias("a"), side("j").alias("b")).select("a", F.when(F.col("cell.i") != F.col("cell.j"), F.col("b")).alias("b"))
    bits, schema = ID_BITS, "page bigint, code bigint, n bigint"
    runs = lists.mapInArrow(lambda batches: _spilled(batches, bits), schema)
    counted = runs.repartition("page", "code").sortWithinPartitions("page", "code").mapInArrow(_merged, schema).where(F.col("n") >= least)
    half = lambda c: (F.shiftright(c, 32), F.col(c).bitwiseAND(F.lit((1 << 32) - 1)))
    low, high = (F.shiftleft(page, bits).bitwiseOR(code) for page, code in zip(half("page"), half("code")))
    one = numbered.select(F.col("term_id").alias("low"), F.col("term").alias("item_a"), F.col("n_item").alias("n_a"))
    two = numbered.select(F.col("term_id").alias("high"), F.col("term").alias("item_b"), F.col("n_item").alias("n_b"))
    pairs = counted.select(low.alias("low"), high.alias("high"), F.col("n").alias("n_ab")).join(one, "low").join(two, "high")
    n = F.lit(total).cast("bigint")
    pairs = pairs.where((F.col("n_ab") * n).cast("double") >= F.lit(float(least_lift)) * F.col("n_a") * F.col("n_b"))
    both, only_a, only_b = F.col("n_ab") + 0.5, F.col("n_a") - F.col("n_ab") + 0.5, F.col("n_b") - F.col("n_ab") + 0.5
    neither = n - F.col("n_a") - F.col("n_b") + F.col("n_ab") + 0.5
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", n.alias("n"), (F.col("n_ab") * n / (F.col("n_a") * F.col("n_b"))).alias("lift"), (both * neither / (only_a * only_b)).alias("odds_ratio"))
