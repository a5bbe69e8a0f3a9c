"""Sentence boundaries across languages and scripts (problem 6).

A blank line ends a sentence, a single line break never does. Within a paragraph, semi-Markov
dynamic programming selects whole sentence spans among all places where a sign could end one: every span
scores its length, the word that opens it, the word or sign that closes it, and the quotations and brackets
that its end would cut, however long they are. Nothing is ruled out before: an abbreviation weighs against
an end, but a span of thousands of code points may yet end there.
No language has to be declared; the script at hand decides which signs end a sentence.

Defined cases: null, empty and blank texts have no sentences; sentences are numbered from 0 in
each document; a repeated row gives its sentences again unless the caller dedups; other columns
are ignored. Long paragraphs cost time in proportion to their length: the score of a length has four pieces,
and in each the best beginning is known from a moving window, so a span may reach back over any number of ends.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that a word of their sentence follows.
LEADING = set(
    "abb abs adm al-a alc anm apdo approx apr art aug av avda bd bde bl bzgl ca cap capt cf ch chap cit cmdr col comm cpl dec dept dir dr dra dras dres "
    "ed eds ee egl eig env esp evtl excmo exp feb fed ff fig figs fl fr frl frhr ft gen ggf gob gov hon hr hrn hrsg ibid id ill imp incl ing inkl inv jan kap lic lb lbs lfg lib lt ltda "
    "maj max mgr min mio mlle mlles mme mmes mr mrs ms msgr mt mts mwst nos nov nr núm núms oct ob op pag pág págs pag par pl plur pp pr prof profa proff pt rd red ref rep res resp rev rs rt "
    "sec sen sep sept sgt sog sr sra sras sres srta st sta ste sto str suppl tel th tom trad univ vgl viz vol vols vs vv zit zzgl z.b i.e e.g d.h c.-à-d j.-c no "
    "акад гл гг гр д-р доц др им инж кн напр нем обл пер пл пос пр прим проф ред рис руб св см соч стр табл тел тыс ул чл англ гос долл млн млрд "
    "पं पृ प्रो डॉ रु श्रीम कु सं क्र".split()
)
# Abbreviations that may also end a sentence.
TRAILING = set("jr sr inc ltd co corp etc usw al p.m a.m u.s u.k ph.d m.d b.c a.d d.c uu bzw ff г руб др д п e.v gmbh d.c".split())
# Second parts of spaced abbreviations, by the part before.
PAIRED = {("z", "b"), ("d", "h"), ("u", "a"), ("a", "d"), ("p", "ej"), ("a", "c"), ("d", "c"), ("т", "е"), ("т", "д"), ("т", "п"), ("и", "о"), ("ee", "uu"), ("av", "j.-c"), ("s", "o"), ("o", "ä"), ("u", "u"), ("i", "e"), ("e", "g")}
# What follows an ordinal number within a German sentence.
ORDINAL = set("januar jänner februar märz april mai juni juli august september oktober november dezember jahrhundert jahrhunderts jahrhunderte jahrtausend jh jahrestag geburtstag mal klasse auflage band kapitel stock".split())
# Particles that open names in lower case.
PARTICLES = set("de del della der den di da dos du la le van von vom zu ten ter af al el ibn bin".split())
# Abbreviations only before a number, as they are words too.
NUMBERED = set("abb art ch chap fig figs no nos nr núm núms pag pág págs par sec sect vol vols гл рис стр табл".split())

_BLANK_LINE = re.compile(r"\n[ \t\r\f\v 　]*\n\s*")
_END = re.compile(r"([.!?…‥。！？｡．।॥؟۔։።]+)((?:[  \n]?»|[”\"’')\]}」』》）】〉›“])*)(\s*)")
_THAI = re.compile(r"(?<=[฀-๿຀-໿ក-៿])[  ]+(?=[฀-๿຀-໿ក-៿“\"(])")
_BEFORE = re.compile(r"(?:[^\W_]|[ऀ-ॿ])(?:[^\W_]|[.'’ऀ-ॿ-])*$")
_WORD = re.compile(r"[^\W_][^\W_'’-]*")
_MARKS = re.compile(r"[()\[\]{}「」『』《》（）【】〈〉«»‹›“”„\"]")
_CLOSES = {")": "(", "]": "[", "}": "{", "」": "「", "』": "『", "》": "《", "）": "（", "】": "【", "〉": "〈", "»": "«", "›": "‹", "”": "“"}
_FULL = set("。！？｡．।॥؟۔։።")
_OPENERS = set("“„\"«‹「『《（(【[¿¡—–-•*")
#: Weights of an end that its word or sign speaks against, and of one within a quotation or bracket.
AGAINST, CUT = -5.0, -20.0
#: Code points below which a sentence is short, up to which it costs nothing, and from which more of them don't.
SHORT, LONG, ENDLESS = 24, 400, 2800


def _wide(c: str) -> bool:
    return "⺀" <= c <= "鿿" or "가" <= c <= "힯" or "豈" <= c <= "﫿" or "＀" <= c <= "￯"


def _pairs(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of matching quotations and brackets that no other encloses, of any length."""
    stack, found, opened = [], [], Counter()

    def close(c: str, at: int) -> None:
        while (top := stack.pop())[0] != c:
            opened[top[0]] -= 1
        opened[c] -= 1
        found.append((top[1], at))

    for m in _MARKS.finditer(text):
        c, at = m[0], m.start()
        if c == '"':
            if stack and stack[-1][0] == '"':
                close('"', at)
            elif at == 0 or not text[at - 1].isalnum():
                stack.append((c, at))
                opened[c] += 1
            continue
        if c in "“”" and stack and stack[-1][0] == "„":
            close("„", at)
            continue
        opens = _CLOSES.get(c)
        if opens is None:
            stack.append((c, at))
            opened[c] += 1
        elif opened[opens]:
            close(opens, at)
    starts, ends = [], []
    for s, e in sorted(found):
        if not ends or s > ends[-1]:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _opening(text: str, at: int) -> float:
    """How well the words from `at` open a sentence, -6 to 0."""
    while at < len(text) and (text[at] in _OPENERS or text[at].isspace()):
        if text[at] in "—–" and at + 1 < len(text) and text[at + 1].isspace():
            return -6.0
        at += 1
    if at >= len(text):
        return 0.0
    c = text[at]
    if c in ",;:%)]}»”、，；：":
        return -6.0
    if c.isdigit():
        return -0.6
    m = _WORD.match(text, at)
    word = m[0] if m else c
    if c.islower() and not any(x.isupper() for x in word[1:3]):
        return -0.1 if word in PARTICLES and text[m.end() : m.end() + 24].lstrip()[:1].isupper() else -4.0
    return 0.0


def _closing(text: str, start: int, sign: str, closers: str, gap: str, follows: int) -> float:
    """How well the sign at `start` closes a sentence whose next one would begin at `follows`, -5 to 5."""
    last, nxt = sign[-1], text[follows : follows + 1]
    if last in _FULL:
        if closers and nxt and nxt not in _OPENERS and not nxt.isupper() and not nxt.isdigit():
            return AGAINST  # scripts without case: what follows a quotation or bracket belongs to its sentence
        return 5.0
    wide = bool(nxt) and (_wide(nxt) or nxt in "「『《（“«¿¡")
    if sign in ("…", "……", "..", "...") or sign.startswith("..") or last in "…‥":
        return 2.0 if gap and (nxt.isupper() or nxt in _OPENERS) else AGAINST
    before = _BEFORE.search(text, max(0, start - 24), start)
    word = before[0] if before else ""
    head, _, tail = word.rpartition(".")
    if len(head.rpartition(".")[2]) > 3 and head[-1:].isalpha():  # two sentences stand without a blank between them
        word = tail
    if not gap:
        c = text[start - 1 : start]
        joined = not closers and (len(word) < 2 or "." in word or word.lower() in LEADING) and not word.isdigit()
        if not wide and not (nxt.isupper() and text[follows + 1 : follows + 2].islower()) or joined or not (c.isalnum() or closers or c in "!?." or "ऀ" <= c <= "ॿ"):
            return AGAINST
        return 2.5
    if last in "!?":
        return 4.0
    if closers:
        return 3.5
    folded = word.lower()
    if folded.replace(".", "").isdigit() and folded:
        following = _WORD.match(text, follows)
        return AGAINST if following and following[0].lower() in ORDINAL and len(folded) <= 2 else 3.0
    bare = folded.rpartition("'")[2].rpartition("’")[2]
    previous = _BEFORE.search(text[max(0, start - 24) : start - len(word)].rstrip().rstrip("."))
    pair = (previous[0].lower() if previous else "", bare)
    if pair in PAIRED:
        return AGAINST if nxt.isdigit() or pair not in {("т", "д"), ("т", "п"), ("ee", "uu")} else 1.0
    if bare in TRAILING:
        return 0.5
    if bare in NUMBERED and not nxt.isdigit():
        return 3.0
    if bare in LEADING or re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", bare):
        return AGAINST
    return AGAINST if len(word) == 1 and word.isalpha() and not _wide(word) else 3.0


def _length(text: str, start: int, end: int) -> float:
    """How likely a sentence is that long."""
    n = end - start
    if n < SHORT:
        wide = sum(_wide(c) for c in text[start:end])
        words = n + 2 * wide
        return -4.0 if words < 3 else -1.2 if words < 8 else -0.8 if words < 11 else 0.0
    return 0.0 if n <= LONG else (LONG - min(n, ENDLESS)) / LONG


class _Window:
    """The greatest value of the nodes whose places are at least `low` and at most `high` before the end at hand."""

    def __init__(self, low: int, high: float) -> None:
        self.low, self.high, self.next, self.held = low, high, 0, deque()

    def best(self, end: int, places: list[int], values: list[float]) -> tuple[float, int] | None:
        while self.next < len(values) and end - places[self.next] >= self.low:
            while self.held and values[self.held[-1]] < values[self.next]:
                self.held.pop()
            self.held.append(self.next)
            self.next += 1
        while self.held and end - places[self.held[0]] > self.high:
            self.held.popleft()
        return (values[self.held[0]], -self.held[0]) if self.held else None


def _chosen(text: str, nodes: list[tuple[int, int, float]]) -> list[int]:
    """Numbers of the nodes (end of a sentence, start of the next, weight of the end) on the path of greatest weight."""
    places, begin, sloped, back = [0], [0.0], [0.0], [0]
    usual, long, endless = _Window(SHORT, LONG), _Window(LONG + 1, ENDLESS), _Window(ENDLESS + 1, math.inf)
    for j in range(1, len(nodes)):
        end, follows, weight = nodes[j]
        options = []
        if found := usual.best(end, places, begin):
            options.append(found)
        if found := long.best(end, places, sloped):
            options.append((found[0] + (LONG - end) / LONG, found[1]))
        if found := endless.best(end, places, begin):
            options.append((found[0] + (LONG - ENDLESS) / LONG, found[1]))
        i = j - 1
        while i >= 0 and end - places[i] < SHORT:
            if places[i] < end:
                options.append((begin[i] + _length(text, places[i], end), -i))
            i -= 1
        value, at = max(options)
        value += weight + _opening(text, follows)
        back.append(-at)
        places.append(follows)
        begin.append(value)
        sloped.append(value + follows / LONG)
    path, j = [], len(nodes) - 1
    while j:
        path.append(j)
        j = back[j]
    return [0, *reversed(path)]


def _paragraph(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    part = text[low:high]
    starts, ends = _pairs(part)

    def cut(at: int) -> float:
        k = bisect_left(starts, at) - 1
        return CUT if k >= 0 and at <= ends[k] else 0.0

    nodes = {}
    for m in _END.finditer(part):
        end, follows = m.end(2), m.end(3)
        if follows < len(part):
            nodes[end, follows] = _closing(part, m.start(), m[1], m[2], m[3], follows) + cut(end)
    for m in _THAI.finditer(part):
        nodes.setdefault(m.span(), 2.0 + cut(m.start()))
    if not nodes:
        spans = [(0, len(part))]
    else:
        ordered = [(0, 0, 0.0), *sorted((e, f, w) for (e, f), w in nodes.items()), (len(part), len(part), 0.0)]
        path = _chosen(part, ordered)
        spans = [(ordered[i][1], ordered[j][0]) for i, j in zip(path, path[1:])]
    for s, e in spans:
        sentence = part[s:e]
        s, e = s + len(sentence) - len(sentence.lstrip()), e - len(sentence) + len(sentence.rstrip())
        if e > s:
            yield low + s, low + e


def split(text: str | None) -> list[tuple[int, int]]:
    """Spans of the sentences of a text, in code points, without outer blanks."""
    if not text:
        return []
    spans, low = [], 0
    for m in _BLANK_LINE.finditer(text):
        spans.extend(_paragraph(text, low, m.start()))
        low = m.end()
    spans.extend(_paragraph(text, low, len(text)))
    return spans


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sent_idx, start_char, end_char, sentence) of each document row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                for n, (s, e) in enumerate(split(t)):
                    for column, x in zip(rows, (d, n, s, e, t[s:e])):
                        column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.record_batch([pa.array(r, k) for r, k in zip(rows, kinds)], ["doc_id", "sent_idx", "start_char", "end_char", "sentence"])

    chosen = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(scan, "doc_id bigint, sent_idx int, start_char int, end_char int, sentence string")
