"""Tokens, heads and named spans of sentences: one pass, then everything stays columnar.

The default annotator is a set of rules and only approximates a statistical model; pass another
`annotate` function to plug one in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiesmith.schemas import ENTITIES, TOKENS

# Words without content of their own.
STOP = set(
    "a about above across after afterwards again against all almost alone along already also although always am among an and another any anyone anything are around as at be became because become been before behind being below beside "
    "besides between beyond both but by can cannot could did do does doing done down during each either else ever every everyone few for former from further get give had has have he hence her here hers herself him himself his how however "
    "i if in into is it its itself just last least less made make many may me might mine more most much must my myself neither never no nobody none nor not nothing now of off often on once one only onto or other others our ours out over own "
    "per perhaps put quite rather same see seem several she should since so some such than that the their theirs them then there these they this those through thus to together too toward under until up upon us very via was we well were "
    "what when where whether which while who whom whose why will with within without would yet you your yours".split()
)
# Words by which institutions and dates are known.
INSTITUTIONS = {"university", "institute", "college", "laboratory", "academy", "observatory", "museum", "polytechnic", "society", "school", "council", "company", "hospital"}
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_TOKEN = re.compile(r"\s{2,}|\w+(?:['’-]\w+)*|[^\w\s]")
_DATE = re.compile(rf"\b(?:(?:\d{{1,2}} )?(?:{MONTHS})(?: \d{{1,2}},?)?(?: \d{{4}})?|(?:the )?(?:early |late |mid-)?1[0-9]\d\ds?|20\d\d)\b")
_NAMES = re.compile(r"\b(?:[A-ZÀ-Þ][\w'’-]*)(?:(?: (?:of|for|the|and|de|von)){0,2} [A-ZÀ-Þ][\w'’-]*)*")
_PLACE = re.compile(r"\b(?:in|at|from|near|to|of) $")


def by_rule(text: str, stop: Collection[str] = STOP) -> tuple[list[dict], list[dict]]:
    """(tokens, named spans) of one sentence. Every word hangs on the first verb-like word, modifiers on the next word.

    Another list of stop words goes in by `functools.partial(by_rule, stop=...)`.
    """
    tokens = [{"i": i, "idx": m.start(), "text": m[0], "head": 0, "is_space": m[0].isspace(), "is_stop": m[0].lower() in stop, "is_punct": not m[0].isspace() and not any(c.isalnum() for c in m[0])} for i, m in enumerate(_TOKEN.finditer(text))]
    words = [t for t in tokens if not t["is_space"] and not t["is_punct"]]
    verbs = [t for t in words if not t["is_stop"] and t["text"][0].islower() and re.search(r"(?:ed|wrote|built|met|taught|led|won|held|left|found)$", t["text"])]
    root = (verbs or [t for t in words if not t["is_stop"]] or tokens or [{"i": 0}])[0]["i"]
    for k, t in enumerate(tokens):
        after = tokens[k + 1] if k + 1 < len(tokens) else None
        modifies = after and not after["is_punct"] and not after["is_space"] and (t["text"][:1].isupper() and after["text"][:1].isupper() or t["is_stop"] and not after["is_stop"])
        t["head"] = t["i"] if t["i"] == root else after["i"] if modifies and t["i"] != root else root
    spans = [{"start": m.start(), "end": m.end(), "label": "DATE", "text": m[0]} for m in _DATE.finditer(text)]
    for m in _NAMES.finditer(text):
        known = {w.lower() for w in re.findall(r"\w+", m[0])}
        if any(s["start"] < m.end() and m.start() < s["end"] for s in spans):
            continue
        if known & INSTITUTIONS:
            spans.append({"start": m.start(), "end": m.end(), "label": "ORG", "text": m[0]})
        elif _PLACE.search(text[: m.start()]) and " " not in m[0]:
            spans.append({"start": m.start(), "end": m.end(), "label": "GPE", "text": m[0]})
    return tokens, sorted(spans, key=lambda s: (s["start"], s["end"]))


def annotate(sentences: DataFrame, key: str = "sentence_id", text: str = "text", annotator: Callable[[str], tuple[list[dict], list[dict]]] = by_rule) -> DataFrame:
    """(key, text, tokens, ents) of each distinct sentence: duplicates go before the costly pass."""

    @F.arrow_udf(f"struct<tokens:{TOKENS},ents:{ENTITIES}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = pa.struct([("i", pa.int32()), ("idx", pa.int32()), ("text", pa.string()), ("head", pa.int32()), ("is_space", pa.bool_()), ("is_stop", pa.bool_()), ("is_punct", pa.bool_())])
        entity = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("text", pa.string())])
        for texts in batches:
            done = [annotator(t) if t else ([], []) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([d[0] for d in done], pa.list_(token)), pa.array([d[1] for d in done], pa.list_(entity))], ["tokens", "ents"])

    once = sentences.groupBy(key).agg(F.min(text).alias(text))
    return once.withColumn("a", run(F.col(text))).select(key, text, "a.tokens", "a.ents")
