"""Evaluation items that stand, wholly or in part, in corpus documents (problem 8).

A passage that keeps `need` of an item's n words lacks at most n - need of them, so of any K words of
the item it holds K - (n - need). Stretches with so many of an item's rarer words, within the length that the
gaps allow, are candidates, and an alignment in item order decides them: no passage is lost before it.
A passage takes at most twice the item's words, or else needs neighbouring words of the item, which a
generalised suffix automaton of the folded words of all items finds. The items are a fixed small table: they
travel to the workers in blocks whose size is checked, so a longer list costs more passes,
not more memory.

Defined cases: null or empty texts and items match nothing; repeated item rows count once, and
so do repeated document rows; items with fewer than `least_words` words must stand whole; ties
between passages go to the earliest; other columns of either table are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiesmith.llm.text import WORD, fold, settle

#: Words of items in one block (one automaton, about 300 bytes a word on a worker).
BLOCK_WORDS = 400_000
#: Words that stand in more than one of so many items are sought only where others are too few.
OFTEN = 3
SCHEMA = "doc_id bigint, item_id bigint, matched int, item_words int, longest int, start_char int, end_char int"


class SuffixAutomaton:
    """Minimal automaton of all fragments of several sequences of integers."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.owned: dict[int, frozenset[int]] = {}
        for number, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].append((number, at))
        self._spread()

    def _state(self, moves: dict[int, int], link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, parent: int, symbol: int) -> int:
        """The state that parent's move leads to, cloned if it also holds longer fragments."""
        target = self.next[parent][symbol]
        if self.length[target] == self.length[parent] + 1:
            return target
        clone = self._state(dict(self.next[target]), self.link[target], self.length[parent] + 1)
        self.link[target] = clone
        while parent >= 0 and self.next[parent].get(symbol) == target:
            self.next[parent][symbol] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        state = self._state({}, 0, self.length[last] + 1)
        parent = last
        while parent >= 0 and symbol not in self.next[parent]:
            self.next[parent][symbol] = state
            parent = self.link[parent]
        self.link[state] = self._split(parent, symbol) if parent >= 0 else 0
        return state

    def _spread(self) -> None:
        """Give every state the ends of all fragments that have it as a suffix."""
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]].extend(self.ends[state])

    def matches(self, symbols: list[int], first: int, least: int = 2) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the longest match that ends at each of `symbols`, where it reaches `least`."""
        state, length = 0, 0
        moves, link, longest = self.next, self.link, self.length
        for at, symbol in enumerate(symbols, first):
            following = moves[state].get(symbol)
            while following is None and state:
                state = link[state]
                length = longest[state]
                following = moves[state].get(symbol)
            if following is None:
                state, length = 0, 0
            else:
                state, length = following, length + 1
                if length >= least:
                    yield at, length, state

    def holders(self, state: int, length: int, least: int = 2) -> dict[int, int]:
        """Sequence to the length of its longest fragment that ends a match."""
        out: dict[int, int] = {}
        while state > 0 and length >= least:
            for number in self.owners(state):
                out.setdefault(number, length)
            state = self.link[state]
            length = self.length[state]
        return out

    def owners(self, state: int) -> frozenset[int]:
        """The sequences that hold a fragment, found once however often it occurs."""
        if (found := self.owned.get(state)) is None:
            found = self.owned[state] = frozenset(number for number, _ in self.ends[state])
        return found

    def held(self, state: int, length: int, number: int, least: int = 2) -> int:
        """Length of the longest fragment of one sequence that ends a match, 0 if it is below `least`; other sequences cost nothing."""
        while state > 0 and length >= least:
            if number in self.owners(state):
                return length
            state = self.link[state]
            length = self.length[state]
        return 0


class Matcher:
    """Items of one block, ready to be looked for in documents."""

    def __init__(self, items: list[tuple[int, list[str]]], share: float, gap: int, least_words: int, most_longest: int | None = None) -> None:
        self.numbers = {w: n for n, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.items = [(i, [self.numbers[w] for w in ws]) for i, ws in items]
        self.need = [len(ws) if len(ws) < least_words else math.ceil(share * len(ws) - 1e-9) for _, ws in items]
        self.gap, self.most_longest = gap, most_longest
        self.automaton = SuffixAutomaton([ws for _, ws in self.items])
        self.singles = {ws[0]: [] for _, ws in self.items if len(ws) == 1}
        for number, (_, ws) in enumerate(self.items):
            if len(ws) == 1:
                self.singles[ws[0]].append(number)
        self.folded: dict[str, int] = {}
        self._rarer()
        codes = [a * (len(self.numbers) + 1) + b for _, ws in self.items for a, b in zip(ws, ws[1:])]
        self.pairs = np.unique(np.array(codes, np.int64))

    def _rarer(self) -> None:
        """The words by which each item is sought, how many of them a passage holds, and within how many words."""
        self.times = [Counter(ws) for _, ws in self.items]
        spread = Counter(w for times in self.times for w in times)
        often, held = 1 + len(self.items) // OFTEN, [[] for _ in range(len(self.numbers))]
        self.least, self.within = np.ones(len(self.items), np.int64), np.ones(len(self.items), np.int64)
        for number, (_, ws) in enumerate(self.items):
            lacking, times, sought = len(ws) - self.need[number], self.times[number], 0
            for w in sorted(times, key=lambda w: (spread[w], w)):
                if sought > lacking and spread[w] > often:
                    break
                sought += times[w]
                held[w].append(number)
            self.least[number] = sought - lacking
            self.within[number] = (self.need[number] - 1) * (self.gap + 1) + 1
        self.sizes = np.array([len(h) for h in held], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.seekers = np.array([number for h in held for number in h], np.int64)

    def windows(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, low, high): the parts of a document that can hold a passage of an item."""
        at = np.flatnonzero(ids >= 0)
        times = self.sizes[ids[at]]
        number = self.seekers[np.repeat(self.first[ids[at]] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        enough = np.bincount(number, minlength=len(self.items)) >= self.least
        kept = np.flatnonzero(enough[number])
        if not len(kept):
            return
        number, at = number[kept], np.repeat(at, times)[kept]
        by = np.argsort(number, kind="stable")
        number, at = number[by], at[by]
        last = np.arange(len(at)) + self.least[number] - 1
        inside = np.minimum(last, len(at) - 1)
        begins = np.flatnonzero((last < len(at)) & (number[inside] == number) & (at[inside] - at < self.within[number]))
        held = None
        for k in begins.tolist():
            item = int(number[k])
            wide = len(self.items[item][1]) * (self.gap + 1)
            low, high = max(0, int(at[k]) - wide), min(len(ids), int(at[last[k]]) + wide + 1)
            if held and held[0] == item and low <= held[2]:
                held = (item, held[1], max(high, held[2]))
            else:
                if held:
                    yield held
                held = (item, low, high)
        if held:
            yield held

    def segments(self, ids: np.ndarray, item: int, low: int, high: int) -> Iterator[tuple[int, int]]:
        """Parts of ids[low:high] without a longer gap that hold enough of an item's words, each as often as the item."""
        times = self.times[item]
        at = [i for i, w in enumerate(ids[low:high].tolist(), low) if w in times]
        if len(at) < self.need[item]:
            return
        begin = 0
        for k in range(1, len(at) + 1):
            if k == len(at) or at[k] - at[k - 1] > self.gap + 1:
                if k - begin >= self.need[item]:
                    part = Counter(ids[at[begin:k]].tolist())
                    if sum(min(c, times[w]) for w, c in part.items()) >= self.need[item]:
                        yield at[begin], at[k - 1] + 1
                begin = k

    def ids(self, tokens: list[str]) -> np.ndarray:
        known, out = self.folded, []
        for t in tokens:
            n = known.get(t)
            if n is None:
                n = self.numbers.get(fold(t), -1)
                if len(known) < 1_000_000:
                    known[t] = n
            out.append(n)
        return np.array(out, np.int64)

    def chains(self, ids: np.ndarray, item: int, low: int, high: int) -> tuple[int, int, int, int]:
        """(words matched, longest run, first, last) of the best passage of an item in ids[low:high]."""
        where = defaultdict(list)
        for j, w in enumerate(self.items[item][1]):
            where[w].append(j)
        best, kept = (0, 0, 0, 0), []
        for i in range(low, high):
            for j in where.get(int(ids[i]), ()):
                mine = (1, 1, 1, i)
                for other, (p, q) in reversed(kept):
                    if i - p > self.gap + 1:
                        break
                    if p < i and q < j:
                        run = other[1] + 1 if p == i - 1 and q == j - 1 else 1
                        mine = max(mine, (other[0] + 1, run, max(other[2], run), other[3]), key=lambda x: (x[0], x[3]))
                kept.append((mine, (i, j)))
                if mine[0] > best[0]:
                    best = (mine[0], mine[2], mine[3], i)
        return best

    def passage(self, ids: np.ndarray, item: int, start: int, stop: int, low: int, high: int) -> tuple[int, int, int, int]:
        """The best passage of an item in ids[start:stop] that takes no more than twice the item's words.

        A longer one counts where fragments of two or more words around it hold a good third of the item.
        """
        n = len(self.items[item][1])
        best = self.chains(ids, item, start, stop)
        if best[0] < self.need[item] or best[3] - best[2] < 2 * n:
            return best
        total, last = 0, low - 1
        for end, length, state in self.automaton.matches(ids[low:high].tolist(), low):
            if held := self.automaton.held(state, length, item):
                total, last = total + end - max(last, end - held), end
        if total >= min(self.need[item], max(2, 0.35 * n)):
            return best
        mine = set(self.items[item][1])
        begins = [i for i in range(start, stop) if int(ids[i]) in mine]
        return max((self.chains(ids, item, i, min(stop, i + 2 * n)) for i in begins), key=lambda x: x[0])

    def runs(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first, last) of the verbatim runs of at least `most_longest` words of an item."""
        least = max(2, self.most_longest)
        if len(ids) < least or not len(self.pairs):
            return
        code = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * (len(self.numbers) + 1) + ids[1:], -1)
        near = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        other = np.r_[-1, np.flatnonzero(self.pairs[near] != code), len(code)]
        for k in np.flatnonzero(np.diff(other) >= least):
            low, high = int(other[k]) + 1, int(other[k + 1]) + 1
            for end, length, state in self.automaton.matches(ids[low:high].tolist(), low, least):
                for item, held in self.automaton.holders(state, length, least).items():
                    yield item, end - held + 1, end

    def find(self, text: str) -> list[tuple[int, int, int, int, int, int]]:
        """(item id, matched, words, longest run, start, end in `text`) of each item that leaked."""
        settled = settle(text)
        ids = self.ids(WORD.findall(settled))
        found: dict[int, tuple[int, int, int, int]] = {}
        for item, low, high in self.windows(ids):
            for start, stop in self.segments(ids, item, low, high):
                best = self.passage(ids, item, start, stop, low, high)
                if best[0] >= self.need[item] and best[0] > found.get(item, (0,))[0]:
                    found[item] = best
        if self.most_longest is not None:
            longest: dict[int, tuple[int, int, int, int]] = {}
            for item, first, last in self.runs(ids):
                run = last - first + 1
                if item not in found and run > longest.get(item, (0,))[0]:
                    longest[item] = (run, run, first, last)
            found |= longest
        for at in np.flatnonzero(np.isin(ids, list(self.singles))) if self.singles else ():
            for item in self.singles[int(ids[at])]:
                found.setdefault(item, (1, 1, int(at), int(at)))
        if not found:
            return []
        spans = [m.span() for m in WORD.finditer(settled)]
        return [(self.items[k][0], m, len(self.items[k][1]), run, spans[a][0], spans[b][1]) for k, (m, run, a, b) in found.items()]


def blocks(items: DataFrame, most_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, list[str]]]]:
    """The distinct items with their folded words, in blocks of bounded size."""
    block, size, seen = [], 0, set()
    for row in items.select("item_id", "text").dropna().distinct().orderBy("item_id", "text").toLocalIterator():
        ws = [fold(w) for w in WORD.findall(settle(row.text))]
        if not ws or (row.item_id, tuple(ws)) in seen:
            continue
        seen.add((row.item_id, tuple(ws)))
        if block and size + len(ws) > most_words:
            yield block
            block, size, seen = [], 0, set()
        block.append((row.item_id, ws))
        size += len(ws)
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.6, gap: int = 8, least_words: int = 5, most_longest: int | None = None) -> DataFrame:
    """One row for each document and item of which `share` of the words stand there as one passage.

    With `most_longest`, also for each of which so long a verbatim run stands there, whatever its share; the run is the passage then.

    `gap`: foreign words that may stand between two of the item's. `longest` is the longest
    verbatim run in words; `start_char` and `end_char` bound the passage in the stored text.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND length(text) > 0")
    parts = []
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, share, gap, least_words, most_longest)
            for batch in batches:
                rows = [(d.as_py(), *x) for d, t in zip(batch.column(0), batch.column(1)) for x in matcher.find(t.as_py())]
                names = ["doc_id", "item_id", "matched", "item_words", "longest", "start_char", "end_char"]
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
                yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        parts.append(texts.mapInArrow(scan, SCHEMA))
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    best = F.max(F.struct("matched", "longest", (-F.col("start_char")).alias("early"), "item_words", "start_char", "end_char")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.matched", "b.item_words", "b.longest", "b.start_char", "b.end_char")


def decontaminate(documents: DataFrame, items: DataFrame, most_longest: int = 12, most_share: float = 0.6, **how) -> DataFrame:
    """Every document row with `clean_text`: passages whose longest run reaches `most_longest` words or
    whose coverage reaches `most_share` are cut out. Overlapping passages are cut once; null texts stay null.
    """
    found = leaks(documents, items, share=min(most_share, 0.6), most_longest=most_longest, **how)
    cut = found.where((F.col("longest") >= most_longest) | (F.col("matched") >= most_share * F.col("item_words")))
    spans = cut.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start_char", "end_char"))).alias("leak_spans"))
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state, span):
        start = F.greatest(state["at"], span["start_char"])
        kept = F.substring(F.col("text"), state["at"] + 1, F.greatest(F.lit(0), start - state["at"]))
        return F.struct(F.concat(state["out"], kept).alias("out"), F.greatest(state["at"], span["end_char"]).alias("at"))

    done = F.aggregate("leak_spans", empty, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    joined = documents.join(spans.withColumnRenamed("doc_id", "_leak_doc"), F.col("doc_id") == F.col("_leak_doc"), "left").drop("_leak_doc")
    return joined.withColumn("clean_text", F.when(F.col("leak_spans").isNull(), F.col("text")).otherwise(done))
