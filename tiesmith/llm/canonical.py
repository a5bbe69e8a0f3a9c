"""Freely typed values mapped to a canonical list (problem 5).

Each distinct (type, value) is looked up once, so a value that a third of the rows hold costs
no more than a rare one.

1. An Aho-Corasick automaton over the folded canonical names and their aliases (given ones, and the
   turned forms of names with `of` or a comma) finds embedded mentions; the longest that don't overlap
   win. They stand only if no other word is left over that tells entries apart; of several, the longest counts.
2. What remains goes to token-set similarity: a word of the value may be a word of the entry, an
   abbreviation of it, or differ by a few slips of the pen. The words that few entries share, found
   through the shared deletions of near words, give the candidates.

How many entries hold a word is counted over the whole list beforehand. The list goes to the tasks in blocks
of bounded size, each at the head of the values that are looked up in it; what the blocks report of
a value (mentions, telling words, scores) is put together before anything is decided, so the size of a
block doesn't change answers. Defined cases: null values give no row, values without an entry get -1 and
similarity 0, empty ones too; types compare without case; equal entries and ties go to the smaller ref_id;
repeated rows count once; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, combinations
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiesmith.llm.text import words
from tiesmith.session import durable, parallelism

#: Entries of the list that a task holds at a time, about.
BLOCK_ENTRIES = 50_000
#: Words that carry no name of their own.
LINKING = {"a", "an", "and", "at", "de", "for", "in", "of", "on", "s", "the", "to"}
_POSSESSIVE = re.compile(r"['’`´]s\b", re.I)


def tokens(value: str | None) -> list[str]:
    """Folded words without possessive endings."""
    return words(_POSSESSIVE.sub("", value)) if value else []


def slips(word: str) -> int:
    """Slips of the pen that a word of this length may hold."""
    return 0 if len(word) < 4 else 1 if len(word) < 8 else 2


def distance(a: str, b: str, most: int) -> int:
    """Insertions, deletions, changes and swaps of neighbours between a and b, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if older and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def deletions(word: str, most: int) -> set[str]:
    """The word with up to `most` letters left out."""
    return {"".join(word[i] for i in range(len(word)) if i not in gone) for k in range(most + 1) for gone in combinations(range(len(word)), k)}


def content(ws: list[str]) -> list[str]:
    """The words that carry a name."""
    return [w for w in ws if w not in LINKING] or ws


def turned(name: str) -> list[list[str]]:
    """Other orders of a name: `A of B` and `A, B` are also `B A`."""
    out = []
    for sign in (" of ", ","):
        head, found, tail = name.partition(sign)
        if found and tokens(head) and tokens(tail):
            out.append(tokens(tail) + tokens(head))
    return out


@dataclass
class Report:
    """What one block of entries knows of a value."""

    #: (first word, word behind the last, letters, ref) of each mention.
    mentions: list[tuple[int, int, int, int]]
    #: Place of each word that tells entries apart to its weight, -1 where it only resembles such a word.
    telling: dict[int, float]
    #: (ref, weight matched, weight of the entry, places of the words used).
    scores: list[tuple[int, float, float, list[int]]]


def chosen(mentions: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The longest mentions that don't overlap."""
    out: list[tuple[int, int, int, int]] = []
    for m in sorted(set(mentions), key=lambda m: (-m[2], m[0], m[3])):
        if all(m[1] <= o[0] or o[1] <= m[0] for o in out):
            out.append(m)
    return out


def named(ws: list[str], report: Report) -> int | None:
    """The entry that stands in the value, if no telling word is left over."""
    if not (out := chosen(report.mentions)):
        return None
    covered = {k for first, last, _, _ in out for k in range(first, last)}
    return None if any(k not in covered for k in report.telling) else out[0][3]


def decide(ws: list[str], report: Report, least: float) -> tuple[int, float]:
    """(ref_id or -1, similarity)."""
    if (ref := named(ws, report)) is not None:
        return ref, 1.0
    best = (0.0, 0)
    for ref, got, total, used in report.scores:
        left = sum(w if w > 0 else 1.0 for k, w in report.telling.items() if k not in used)
        best = max(best, (got / (total + left), -ref))
    return (-best[1], best[0]) if best[0] >= least else (-1, 0.0)


def together(reports: list[Report]) -> Report:
    """The reports of several blocks on one value as one."""
    telling: dict[int, float] = {}
    for r in reports:
        for k, w in r.telling.items():
            telling[k] = max(w, telling.get(k, w))
    return Report([m for r in reports for m in r.mentions], telling, [s for r in reports for s in r.scores])


class Resolver:
    """Entries (ref, name, aliases) of one type. `share` has how many of all `total` entries hold each of their words."""

    def __init__(self, entries: list[tuple[int, str, list[str]]], least: float = 0.8, share: dict[str, int] | None = None, total: int | None = None) -> None:
        import ahocorasick

        self.least = least
        held = [(ref, name, aliases) for ref, name, aliases in sorted(entries, key=lambda e: (e[0], e[1])) if tokens(name)]
        self.refs = [ref for ref, _, _ in held]
        self.content = [content(tokens(name)) for _, name, _ in held]
        self.share = share if share is not None else Counter(w for ws in self.content for w in set(ws))
        self.weight = {w: log(1 + (total or len(held)) / n) for w, n in self.share.items()}
        #: Entries by their rarest words, which a value has to spell out.
        self.named, self.near = defaultdict(list), defaultdict(set)
        for k, ws in enumerate(self.content):
            rarest = min(self.share[w] for w in ws)
            for w in {w for w in ws if self.share[w] == rarest}:
                self.named[w].append(k)
        self.match, self.similar = lru_cache(500_000)(self._match), lru_cache(100_000)(self._similar)
        self.longest = max(map(len, self.share), default=0) + 2
        for w in self.share:
            for d in deletions(w, slips(w)):
                self.near[d].add(w)
        self.automaton = ahocorasick.Automaton()
        # What is added later replaces what reads the same: names win over aliases, smaller numbers over greater.
        for other in (True, False):
            for ref, name, aliases in reversed(held):
                for ws in [*map(tokens, aliases or ()), *turned(name)] if other else [tokens(name)]:
                    if ws:
                        self.automaton.add_word(f" {' '.join(ws)} ", (ref, len(ws), len(" ".join(ws))))
        if len(self.automaton):
            self.automaton.make_automaton()

    def report(self, ws: list[str], alone: bool = False) -> Report:
        """What these entries know of a value; `alone` leaves scores out where a mention settles it."""
        mentions, telling = [], {}
        if len(self.automaton):
            at = dict(zip(accumulate((len(w) + 1 for w in ws), initial=0), range(len(ws))))
            for end, (ref, n, letters) in self.automaton.iter(f" {' '.join(ws)} "):
                first = at[end - letters - 1]
                mentions.append((first, first + n, letters, ref))
        places = [k for k, w in enumerate(ws) if w not in LINKING] or [*range(len(ws))]
        for k in places:
            if (w := self.tells(ws[k])) is not None:
                telling[k] = w
        out = Report(mentions, telling, [])
        if not alone or named(ws, out) is None:
            candidates = {k for i in places for x in self.similar(ws[i]) for k in self.named.get(x, ())}
            for k in sorted(candidates):
                if (scored := self.score(ws, places, k)) and scored[0] >= self.least * scored[1] - 1e-9:
                    out.scores.append((self.refs[k], *scored))
        return out

    def tells(self, word: str) -> float | None:
        """The weight of a word that tells entries apart, -1 for one that resembles such a word, else None."""
        if (w := self.weight.get(word)) is not None:
            return w
        return -1.0 if len(word) > 3 and any(self.match(word, x) > 0.6 for x in self.similar(word)) else None

    def _similar(self, word: str) -> set[str]:
        if len(word) > self.longest:
            return set()
        return set().union(*(self.near.get(d, ()) for d in deletions(word, slips(word))))

    def _match(self, word: str, of: str, short: bool = False) -> float:
        """How well a word of a value stands for a word of an entry, 0 to 1; `short` allows abbreviations."""
        if word == of:
            return 1.0
        most = min(slips(of), max(slips(word), 1))
        d = distance(word, of, most)
        if d <= most:
            return 1 - d / len(of)
        if short and of.startswith(word):
            return 0.95
        if short and 4 <= len(word) < len(of) and any(distance(word, of[:n], 1) <= 1 for n in (len(word), len(word) + 1)):
            return 0.6
        return 0.0

    def score(self, ws: list[str], places: list[int], k: int) -> tuple[float, float, list[int]] | None:
        """(weight matched, weight of the entry, places used) of the entry's words that the value's stand for.

        The entry's rarest word has to be spelt out; the others may be abbreviated.
        """
        entry, free, got, total, spelt = self.content[k], list(places), 0.0, 0.0, False
        rarest = max(self.weight[w] for w in entry) - 1e-9
        used = []
        for of in sorted(entry, key=lambda w: -self.weight[w]):
            total += self.weight[of]
            best = max(((self.match(ws[i], of), -n, True) for n, i in enumerate(free)), default=(0.0, 0, True))
            if best[0] <= 0:
                best = max(((self.match(ws[i], of, True), -n, False) for n, i in enumerate(free)), default=(0.0, 0, False))
            if best[0] <= 0:
                return None
            got += self.weight[of] * best[0]
            used.append(free.pop(-best[1]))
            spelt = spelt or best[2] and self.weight[of] >= rarest
        return (got, total, used) if spelt else None

    def find(self, value: str | None) -> tuple[int, float]:
        """(ref_id or -1, similarity) where these are all entries."""
        ws = tokens(value)
        return decide(ws, self.report(ws, alone=True), self.least) if ws else (-1, 0.0)


def _kind(column: str) -> Column:
    return F.lower(F.trim(column))


def _entries(reference: DataFrame, aliases: str | None) -> DataFrame:
    """(kind, ref, name, aliases, shares, total): the list with how many entries of the type hold each word, over all of it."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws = [sorted(set(content(tokens(n)))) for n in batch.column(2).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(ws, pa.list_(pa.string()))], ["kind", "ref", "name", "aliases", "words"])

    others = F.array_sort(F.array_distinct(F.filter(F.col(aliases), lambda a: a.isNotNull()))) if aliases else F.lit(None).cast("array<string>")
    rows = reference.select(_kind("attr_type").alias("kind"), F.col("ref_id").cast("bigint").alias("ref"), F.col("canonical").alias("name"), others.alias("aliases"))
    rows = rows.where("kind IS NOT NULL AND ref IS NOT NULL AND name IS NOT NULL").distinct()
    kept = durable(rows.mapInArrow(parse, "kind string, ref bigint, name string, aliases array<string>, words array<string>").where("size(words) > 0"))
    each = kept.select("kind", "ref", "name", "aliases", F.explode("words").alias("word"))
    share = each.groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n"))
    total = kept.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    known = each.join(share, ["kind", "word"]).groupBy("kind", "ref", "name", "aliases").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("shares"))
    return known.join(total, "kind").select("kind", "ref", "name", "aliases", "shares", "total")


REPORT = "mentions array<struct<first:int,last:int,letters:int,ref:bigint>>, telling map<int,double>, scores array<struct<ref:bigint,got:double,total:double,used:array<int>>>"


def resolve(values: DataFrame, reference: DataFrame, least: float = 0.8, aliases: str | None = None) -> DataFrame:
    """(attr_type, value, ref_id, similarity) of each distinct non-null value; attr_type in lower case, ref_id -1 where no entry fits.

    `aliases` names a column of the reference with other names of the entry.
    """
    spark = values.sparkSession
    distinct = values.select(_kind("attr_type").alias("kind"), F.col("value").alias("name")).where("kind IS NOT NULL AND name IS NOT NULL").distinct()
    entries = durable(_entries(reference, aliases))
    blocks = max(1, -(-entries.count() // BLOCK_ENTRIES))
    salts = max(1, -(-parallelism(spark) // blocks))
    within, salt = F.pmod(F.xxhash64("kind", "ref", "name"), F.lit(blocks)), F.pmod(F.xxhash64("kind", "name"), F.lit(salts))
    place = lambda block, part: (block * salts + part).cast("int").alias("part")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = entries.withColumn("salt", every(salts)).select(place(within, F.col("salt")), F.lit(False).alias("sought"), "kind", "name", "ref", "aliases", "shares", "total")
    sought = distinct.withColumn("block", every(blocks)).select(place(F.col("block"), salt), F.lit(True).alias("sought"), "kind", "name", *[F.lit(None).cast(spread.schema[c].dataType).alias(c) for c in ("ref", "aliases", "shares", "total")])
    placed = spread.unionByName(sought).repartitionById(blocks * salts, F.col("part")).sortWithinPartitions("sought", "kind", "name").drop("part")

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, Resolver], list[str], list[str]]]:
        """The resolvers of a block with each batch of its values."""
        lists, share, total, known = defaultdict(list), defaultdict(dict), {}, None
        for batch in batches:
            first = int(np.count_nonzero(~batch.column(0).to_numpy(zero_copy_only=False)))
            for kind, name, ref, others, shares, n in zip(*(c.to_pylist() for c in batch.slice(0, first).columns[1:])):
                lists[kind].append((ref, name, others or []))
                share[kind].update(shares)
                total[kind] = n
            if first < batch.num_rows:
                known = known or {kind: Resolver(rows, least, share[kind], total[kind]) for kind, rows in lists.items()}
                rest = batch.slice(first)
                yield known, rest.column(1).to_pylist(), rest.column(2).to_pylist()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known, kinds, names in looked(batches):
            found = [known[k].find(v) if k in known else (-1, 0.0) for k, v in zip(kinds, names)]
            yield pa.record_batch([pa.array(kinds, pa.string()), pa.array(names, pa.string()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], ["attr_type", "value", "ref_id", "similarity"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("mentions", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("letters", pa.int32()), ("ref", pa.int64())]))), ("telling", pa.map_(pa.int32(), pa.float64())), ("scores", pa.list_(pa.struct([("ref", pa.int64()), ("got", pa.float64()), ("total", pa.float64()), ("used", pa.list_(pa.int32()))])))])
        for known, kinds, names in looked(batches):
            found = [known[k].report(tokens(v)) if k in known and tokens(v) else Report([], {}, []) for k, v in zip(kinds, names)]
            mentions = [[dict(zip(("first", "last", "letters", "ref"), m)) for m in r.mentions] for r in found]
            scores = [[dict(zip(("ref", "got", "total", "used"), s)) for s in r.scores] for r in found]
            columns = [mentions, [[*r.telling.items()] for r in found], scores]
            yield pa.record_batch([pa.array(kinds, pa.string()), pa.array(names, pa.string()), *(pa.array(c, f.type) for c, f in zip(columns, kind))], ["attr_type", "value", *kind.names])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                reports = [Report([tuple(m.values()) for m in r["mentions"]], dict(r["telling"]), [tuple(s.values()) for s in r["scores"]]) for r in rows]
                found.append(decide(tokens(value), together(reports), least))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], ["attr_type", "value", "ref_id", "similarity"])

    result = "attr_type string, value string, ref_id bigint, similarity double"
    if blocks == 1:  # one report a value, decided at once
        return placed.mapInArrow(whole, result)
    reports = placed.mapInArrow(partial, f"attr_type string, value string, {REPORT}")
    return reports.groupBy("attr_type", "value").agg(F.collect_list(F.struct("mentions", "telling", "scores")).alias("reports")).mapInArrow(settle, result)


def map_spans(spans: DataFrame, reference: DataFrame, kinds: tuple[str, ...] = ("place", "institution"), least: float = 0.8, aliases: str | None = None) -> DataFrame:
    """(span_id, attr_type, value, ref_id, similarity) of each distinct span of one of `kinds` with a non-null value."""
    rows = spans.select("span_id", _kind("attr_type").alias("attr_type"), "value").where(F.col("attr_type").isin(*kinds) & F.col("value").isNotNull() & F.col("span_id").isNotNull()).distinct()
    return rows.join(resolve(rows, reference, least, aliases), ["attr_type", "value"]).select("span_id", "attr_type", "value", "ref_id", "similarity")
