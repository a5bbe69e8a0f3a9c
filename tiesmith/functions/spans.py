"""Expressions over arrays of half-open code-point spans struct<start,end>."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = "[PERSON]"


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end], counted from 0."""
    return F.substring(text, start + 1, end - start)


def valid(span: Column, text: Column) -> Column:
    return (span["start"] >= 0) & (span["start"] < span["end"]) & (span["end"] <= F.length(text))


def mask(text: Column, spans: Column, names: Column, placeholder: str = PLACEHOLDER) -> Column:
    """Spans, from right to left and each once, then whole-word names, the longest first, give way to the placeholder.

    Spans out of bounds are left alone; null arrays count as empty.
    """
    spans = F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>"))
    names = F.coalesce(names, F.array().cast("array<string>"))
    good = F.sort_array(F.array_distinct(F.filter(spans, lambda s: valid(s, text))), asc=False)
    hidden = F.aggregate(good, text, lambda t, s: F.concat(F.substring(t, 1, s["start"]), F.lit(placeholder), F.substring(t, s["end"] + 1, F.length(t))))
    # Pairs of (-length, name) sort the longest name first.
    order = F.array_sort(F.transform(F.filter(F.array_distinct(names), lambda n: n.isNotNull() & (n != "")), lambda n: F.struct((-F.length(n)).alias("n"), n.alias("name"))))
    literal = lambda n: F.regexp_replace(n, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.aggregate(order, hidden, lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), literal(n["name"]), F.lit(r"(?![\p{L}\p{N}_])")), F.lit(placeholder)))


def runs(row: np.ndarray, hit: np.ndarray, bridge: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last number of each run of marked tokens with at most `bridge` others between two; `row` says whose they are."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at
    fresh = np.flatnonzero((row[at][1:] != row[at][:-1]) | (np.diff(at) - 1 > bridge)) + 1
    return at[np.r_[0, fresh]], at[np.r_[fresh - 1, len(at) - 1]]


def owners(lists: pa.ListArray) -> np.ndarray:
    """The row of each value of `lists.flatten()`."""
    return np.repeat(np.arange(len(lists)), np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64))


def field(lists: pa.ListArray, name: str) -> np.ndarray:
    return lists.flatten().field(name).to_numpy(zero_copy_only=False)


def islands(tokens: Column, bridge: int = 2) -> Column:
    """Runs of marked tokens with at most `bridge` others between two: array<struct<start,end>>.

    `tokens` is array<struct<start,end,hit>> in order.
    """

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(given: pa.Array) -> pa.Array:
        row = owners(given)
        first, last = runs(row, field(given, "hit").astype(bool), bridge)
        counts = np.bincount(row[first], minlength=len(given)) if len(first) else np.zeros(len(given), np.int64)
        found = pa.StructArray.from_arrays([pa.array(field(given, "start")[first].astype(np.int32)), pa.array(field(given, "end")[last].astype(np.int32))], ["start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), found)

    return run(tokens)
