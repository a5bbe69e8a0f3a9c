"""Paragraphs with offsets, sentences by rule, and sentences joined again across brackets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences joined at most while a bracket is open.
MOST_MERGES = 4
#: Abbreviations after which the default rule doesn't split.
ABBREVIATIONS = ("Dr", "Prof", "Mr", "Mrs", "Ms", "St", "Mt", "Jr", "Sr", "No", "Vol", "Fig", "vs", "cf", "approx", "etc", "e.g", "i.e", "al", "ca", "U.S", "Ph.D")
SPANS = "array<struct<start:int,end:int,text:string>>"
#: A function from a text to the (start, end) of its sentences, in order.
Split = Callable[[str], Iterable[tuple[int, int]]]
_BOUNDARY = regex.compile(r"(?<!\b(?:" + "|".join(map(regex.escape, ABBREVIATIONS)) + r"|\p{Lu}))[.!?]+[\"”’)\]]*\s+(?=[\"“(\[¿¡]?[\p{Lu}\d])")


def parted(text: str, separator: str) -> Iterator[tuple[int, int, str]]:
    """(number, start, text) of the parts between separators that aren't blank."""
    at = 0
    for n, part in enumerate(text.split(separator)):
        if part.strip():
            yield n, at, part
        at += len(part) + len(separator)


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """array<struct<idx,start,text>>: parts between separators with their offsets; blank ones keep their place but are left out."""

    @F.arrow_udf("array<struct<idx:int,start:int,text:string>>")
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("idx", pa.int32()), ("start", pa.int32()), ("text", pa.string())]))
        return pa.array([None if t is None else [dict(zip(("idx", "start", "text"), p)) for p in parted(t, separator)] for t in texts.to_pylist()], kind)

    return run(text)


def ruled(text: str) -> Iterator[tuple[int, int]]:
    """Sentences that end at a full stop, question or exclamation mark before blanks.

    They are trimmed; an abbreviation, a single capital or an open ending doesn't split.
    """
    at = 0
    for end in [*(m.end() for m in _BOUNDARY.finditer(text)), len(text)]:
        part = text[at:end]
        start = at + len(part) - len(part.lstrip())
        if part := part.strip():
            yield start, start + len(part)
        at = end


def splitter(split: Split) -> Split:
    """A split function whose spans are checked: in order, apart and within the text."""

    def run(text: str) -> Iterator[tuple[int, int]]:
        last = 0
        for start, end in split(text):
            if not last <= start < end <= len(text):
                raise ValueError(f"a sentence from {start} to {end} after {last} in a text of {len(text)}")
            yield start, end
            last = end

    return run


def joined(spans: Iterable[tuple[int, int, int]], most: int) -> Iterator[tuple[int, int]]:
    """(start, end, open brackets less closed ones) joined with those after them while brackets are open, at most `most` times."""
    held, balance, merges = None, 0, 0
    for start, end, more in spans:
        if held and balance > 0 and merges < most:
            held, balance, merges = (held[0], end), balance + more, merges + 1
            continue
        if held:
            yield held
        held, balance, merges = (start, end), more, 0
    if held:
        yield held


def merge_brackets(spans: Column, text: Column, most: int = MOST_MERGES) -> Column:
    """Sentences joined with those after them while `[` outnumbers `]`, at most `most` times, then given as they are."""

    @F.arrow_udf(SPANS)
    def run(given: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for row, t in zip(given.to_pylist(), texts.to_pylist()):
            counted = ((s["start"], s["end"], (s["text"] or "").count("[") - (s["text"] or "").count("]")) for s in row or ())
            out.append(None if row is None else [{"start": a, "end": b, "text": (t or "")[a:b]} for a, b in joined(counted, most)])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])))

    return run(spans, text)


def units(sections: DataFrame, split: Split = ruled, separator: str = "\n\n", most: int = MOST_MERGES) -> DataFrame:
    """(doc_id, section_idx, sent_idx, start, end, text, paragraph, merged) of sections (doc_id, section_idx, text).

    Each paragraph is split on its own; offsets and numbers run through the section. `paragraph` numbers the
    paragraphs of a section, `merged` counts the sentences that a bracket joined to this one. A section is one row, so nothing is exchanged.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], ([], [], [], [], [], [])
            for at, text in enumerate(batch.column(2)):
                n = 0
                text = text.as_py() or ""
                for paragraph, base, part in parted(text, separator):
                    spans = [(a, b, part.count("[", a, b) - part.count("]", a, b)) for a, b in split(part)]
                    ends, k = {b: i for i, (_, b, _) in enumerate(spans)}, -1
                    for a, b in joined(spans, most):
                        for column, value in zip(rows, (n, base + a, base + b, part[a:b], paragraph, ends[b] - k - 1)):
                            column.append(value)
                        owner.append(at)
                        n, k = n + 1, ends[b]
            took = pa.array(owner, pa.int64())
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            yield pa.record_batch([batch.column(0).take(took), batch.column(1).take(took), *(pa.array(r, k) for r, k in zip(rows, kinds))], ["doc_id", "section_idx", "sent_idx", "start", "end", "text", "paragraph", "merged"])

    chosen = sections.select("doc_id", "section_idx", "text")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:2]]
    return chosen.mapInArrow(scan, ", ".join(kinds) + ", sent_idx int, start int, end int, text string, paragraph int, merged int")


def segment(sections: DataFrame, split: Split = ruled, separator: str = "\n\n", most: int = MOST_MERGES) -> DataFrame:
    """(doc_id, section_idx, sent_idx, start, end, text): the sentences of `units`."""
    return units(sections, split, separator, most).drop("paragraph", "merged")


def segment_counts(sentences: DataFrame) -> DataFrame:
    """Documents, sections, paragraphs and sentences of the rows of `units`, and how many joins brackets made."""
    key = F.struct("doc_id", "section_idx")
    return sentences.agg(
        F.countDistinct("doc_id").alias("documents"), F.countDistinct(key).alias("sections"), F.countDistinct(F.struct("doc_id", "section_idx", "paragraph")).alias("paragraphs"),
        F.count(F.lit(1)).alias("sentences"), F.coalesce(F.sum("merged"), F.lit(0)).alias("merges"),
    )
