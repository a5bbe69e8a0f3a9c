"""Clean text and structure out of documents with HTML, Markdown, wiki or LaTeX markup (problem 2).

A document becomes a flat buffer with one cell for each code point; markup empties its cells or
puts plain signs into them, so any offset of the stored text leads to one of the clean text, and
`links` keep marking their surfaces. What markup sets off (headings, list items, code blocks, formulas)
is kept as ranges of the buffer.

Boilerplate goes by tree scoring: containers are a tree, paragraphs pass points for length and commas
to their ancestors, discounted by link density and, for names of page furniture, by a weight. The best container
is kept with its ancestors; of what stands beside or directly in it, only containers are kept that have points
enough, read like text, or hold structure with few links; the rest is dropped, whatever it is called.

Defined cases: a null text stays null with no elements, an empty one is empty; elements come once a
document row in order of their place; unclosed blocks end at the next blank line; links without offsets or
whose surface is dropped get null offsets; repeated rows are treated alike; other columns are kept.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML and of wiki extensions.
TAGS = set(
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li "
    "link main mark math meta nav noscript ol option p pre q ref references s samp section select small source span strike strong style sub summary sup svg syntaxhighlight table tbody td template tfoot th thead time title tr tt u ul var video wbr gallery nowiki poem".split()
)
# Elements that stand in a line of text.
INLINE = set("a abbr b big cite code del em font i ins kbd label mark math nowiki q ref s samp small source span strike strong sub sup time tt u var wbr".split())
# Elements that hold blocks, and those of them that rarely hold text.
CONTAINERS = set("article aside blockquote body center details div dl figure footer form header html main nav ol section table ul".split())
DULL = re.compile(r"\b(?:nav|navbox|menu|sidebar|footer|breadcrumbs?|toolbar|banner|cookie|advert|noprint|toc|infobox|catlinks)\b", re.I)

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^<>]*>|<\?[a-z][^<>]*\?>|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>|<sup\b[^<>]*\bref[^<>]*>.*?</sup\s*>", re.I | re.S)
_FENCE_LINE = re.compile(r"(?m)^(?:`{3,}|~{3,})")
_CODE_TAG = re.compile(r"<(/?)(pre|syntaxhighlight|source)\b[^<>]*>", re.I)
_CODE_ENV = re.compile(r"\\(begin|end)\{(?:verbatim\*?|lstlisting|minted|alltt)\}")


@lru_cache(8)
def _code(fences: bool, tags: bool, environments: bool) -> re.Pattern:
    """Code blocks. Where openings and closings of a kind don't match in number, a block also ends at a blank line."""
    end = lambda closed, sign: sign if closed else rf"(?:{sign}|(?=\n[ \t]*\n)|\Z)"
    return re.compile(
        rf"(?m:^(?P<fence>`{{3,}}|~{{3,}})[^\n`]*\n(?P<fenced>.*?){end(fences, r'^(?P=fence)[`~]*[ \t]*$')})"
        rf"|<(?P<tag>pre|syntaxhighlight|source)\b[^<>]*>(?P<tagged>.*?){end(tags, r'</(?P=tag)\s*>')}"
        rf"|\\begin\{{(?P<env>verbatim\*?|lstlisting|minted|alltt)\}}(?:\[[^\]\n]*\]|\{{\w+\}})*(?P<listed>.*?){end(environments, r'\\end\{(?P=env)\}')}",
        re.I | re.S,
    )


_FORMULA = re.compile(
    r"<math\b[^<>]*>(?P<m>.*?)</math\s*>|\$\$(?P<dd>[^$]+?)\$\$|\\\[(?P<br>(?:(?!\\\[).)+?)\\\]|\\\((?P<pa>(?:(?!\\\().)+?)\\\)"
    r"|\\begin\{(?P<env>equation\*?|align\*?|displaymath|gather\*?|multline\*?|math|eqnarray\*?)\}(?P<en>.+?)\\end\{(?P=env)\}"
    r"|(?<![\\$\w])\$(?P<d>(?![\s$])(?:[^$\n]|\n(?![ \t\r]*\n))+(?<![\s\\]))\$(?![\d$])",
    re.I | re.S,
)
_TEX = re.compile(r"\\[A-Za-z]|[=^_<>+]|\\[,;]|^[A-Za-z]$|^[A-Za-z]\(")
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*|/)?)>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_SETEXT = re.compile(r"(?m)^(?P<title>[^\n]*\S)[ \t]*\n(?P<line>={3,}|-{3,})[ \t]*$")
_RULE = re.compile(r"(?m)^[ \t]*(?:-{3,}|\*{3,}|_{3,}|(?:- ){2,}-|(?:\* ){2,}\*)[ \t]*$")
_ATX = re.compile(r"(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$")
_WIKI_HEAD = re.compile(r"(={1,6})[ \t]*([^=\s](?:.*?[^=\s])?)[ \t]*\1[ \t]*$")
_ITEM = re.compile(r"([ \t]*)(?:([*+-])|\d{1,9}[.)])[ \t]+(?=\S)")
_WIKI_ITEM = re.compile(r"(?:[*#]+[:;*#]*|[:;]+[*#]+)[ \t]*(?=[^\s*#])")
_LINE_EMPHASIS = re.compile(r"(\*{1,3})[^\s*][^*\n]*\1(?!\*)")
_TEX_HEAD = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?(?:\[[^\]\n]*\])?\{")
_TEX_ITEM = re.compile(r"\\item\b(?:\[[^\]\n]*\])?[ \t]*")
_TEX_ENV = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?")
_TEX_DROP = re.compile(r"~?\\(?:cite[pt]?|ref|eqref|label|vspace|hspace|pageref|index|bibliography|bibliographystyle|usepackage|documentclass|includegraphics|pagestyle|thispagestyle|input)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}|\\(?:maketitle|tableofcontents|noindent|newpage|clearpage|centering|bigskip|medskip|smallskip)\b")
_TEX_NOTE = re.compile(r"\\(?:footnote|thanks|marginpar)\{(?:[^{}]|\{[^{}]*\})*\}")
_TEX_LINK = re.compile(r"\\href\{((?:[^{}\\]|\\.)*)\}\{")
_TEX_STYLE = re.compile(r"\\(?:textbf|textit|emph|texttt|textsc|textrm|textsf|underline|mbox|text)\{|\{\\(?:it|bf|em|tt|sc|sl|rm)\b[ \t]*")
_TEX_SIGN = re.compile(r"\\([%&_#${}])|\\\\(?:\[[^\]\n]*\])?")
_TEX_COMMENT = re.compile(r"(?m)^[ \t]*%[^\n]*$")
_WIKI_FILE = re.compile(r"\[\[(?:File|Image|Category|Media)\s*:(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]", re.I)
_WIKI_LINK = re.compile(r"\[\[([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]")
_BRACES, _SEEN = re.compile(r"\{+|\}+|\|"), re.compile(r"[^\n]")
_SHOWN = re.compile(r"\{\{\s*(?:lang|transl|nowrap|nobr|small|big|abbr|em|strong|code|var)\s*\|", re.I)
_MAGIC = re.compile(r"__[A-Z]{2,}__")
_WIKI_MARK = re.compile(r"'{2,5}")
_TABLE = re.compile(r"(?m)^[ \t]*(?:\{\|[^\n]*|\|\}|\|-[^\n]*|\|\+|[|!](?![}\-]))|(?<=\s)(?:\|\||!!)(?=\s)")
_IMAGE = re.compile(r"!\[[^\[\]\n]*\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+\"[^\"\n]*\")?\)")
_LINK = re.compile(r"\[((?:[^\[\]\n]|\[[^\[\]\n]*\])+)\]\(((?:[^()\s]|\([^()\s]*\))+)(?:\s+\"[^\"\n]*\")?\)")
_DEFINITION = re.compile(r"(?m)^[ ]{0,3}\[\^?[^\[\]\n]+\]:[ \t]*\S[^\n]*$")
_FOOTNOTE = re.compile(r"\[\^[^\[\]\s]+\]")
_STRONG = re.compile(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])((?:[^*\n]|\n(?![ \t\r]*\n))+)(?<=[^\s*])\1(?![\w*])|(?<![\w\\])(_{1,3})(?=[^\s_])((?:[^_\n]|\n(?![ \t\r]*\n))+)(?<=[^\s_])\3(?![\w])")
_TICK = re.compile(r"(?<!`)`((?:[^`\n]|\n(?![ \t\r]*\n))+)`(?!`)")
_QUOTE = re.compile(r"(?m)^[ ]{0,3}>[ \t]?(?=\S)")
_BREAK = re.compile(r"\n[ \t\r]*\n")
CODE, FORMULA, GONE = "\ue000", "\ue001", "\ue002"
KINDS = ("heading", "list_item", "code", "formula")


class Document:
    """One text with its markup taken apart."""

    def __init__(self, text: str) -> None:
        self.raw, self.work, self.cells = text, text, list(text)
        self.marked, self.ranges = False, []
        self.hidden: list[tuple[int, int]] = []  # what `_show` is to take out of sight
        self.before: dict[int, str] = {}  # signs that stand before a cell of the clean text
        self.wiki = self.markdown = self.tex = False
        self._parse()

    def _cut(self, start: int, end: int, put: str = "") -> None:
        self.cells[start:end] = [put] + [""] * (end - start - 1) if end > start else []

    def _mask(self, pattern: re.Pattern, handle, sign: str = GONE) -> None:
        """Hand each match to `handle`; where it says so, the match is out of sight of later patterns."""

        def sub(m: re.Match) -> str:
            if handle(m) is False:
                return m[0]
            self.marked = True
            return "".join("\n" if c == "\n" and sign == GONE else sign for c in m[0]) if "\n" in m[0] else sign * len(m[0])

        self.work = pattern.sub(sub, self.work)

    def _parse(self) -> None:
        w = self.raw
        if not any(c in w for c in "<&[{*_#=\\$`'~|+-") and not re.search(r"(?m)^\s*\d+[.)] ", w):
            return
        if "<" in w:
            self._mask(_DROP, lambda m: self._cut(*m.span()))
        if "```" in w or "~~~" in w or "<" in w or "\\begin{" in w:
            tags = [bool(m[1]) for m in _CODE_TAG.finditer(self.work)]
            ends = [m[1] == "end" for m in _CODE_ENV.finditer(self.work)]
            self._mask(_code(len(_FENCE_LINE.findall(self.work)) % 2 == 0, 2 * sum(tags) == len(tags), 2 * sum(ends) == len(ends)), self._code, CODE)
        if "$" in w or "\\(" in w or "\\[" in w or "<math" in w.lower() or "\\begin{" in w:
            self._mask(_FORMULA, self._formula, FORMULA)
        w = self.work
        self.wiki = "[[" in w or "{{" in w or "''" in w or "{|" in w or bool(re.search(r"(?m)^==.*==\s*$", w))
        self.markdown = "](" in w or bool(re.search(r"(?m)^#{2,6} |[\s(]\*\*\w|[\s(]__[a-z]|\[\^", w))
        self.tex = "\\" in w and bool(re.search(r"\\(?:documentclass|begin|end|section|subsection|paragraph|item|href|emph|textbf|textit|cite|label|ref|footnote)\b|\{\\(?:it|bf|em)\b", w))
        if self.tex:
            self._latex()
        if "[" in w or "{" in w or "__" in w or "''" in w:
            self._inline_links()
        self._blocks()
        if "<" in w:
            self._tags()
        self._inline_marks()
        if "&" in self.work:
            self._mask(_ENTITY, self._entity)

    def _code(self, m: re.Match) -> bool | None:
        if (m["tag"] or "").lower() == "source" and "/>" in m[0][:80]:
            return False
        name = "fenced" if m["fence"] else "tagged" if m["tag"] else "listed"
        start, end = m.span(name)
        inner = self.raw[start:end]
        if not inner.strip():
            self._cut(*m.span(), "\n")
            return None
        self._cut(m.start(), start, "\n```\n")
        self._cut(end, m.end(), "\n```\n") if end < m.end() else None
        if m["tag"]:
            for t in _TAG.finditer(inner):
                if t[2].lower() in ("code", "span"):
                    self._cut(start + t.start(), start + t.end())
            for e in _ENTITY.finditer(inner):
                self._cut(start + e.start(), start + e.end(), html.unescape(e[0]))
        self.ranges.append(("code", start, end))
        return None

    def _formula(self, m: re.Match) -> bool | None:
        name = next(n for n in ("m", "dd", "br", "pa", "en", "d") if m[n] is not None)
        inner = m[name]
        if name in ("d", "dd") and not _TEX.search(inner) or not inner.strip() or "\n\n" in inner or GONE in inner:
            return False
        start, end = m.span(name)
        wide = name in ("dd", "br", "en") or "block" in m[0][:40]
        self._cut(m.start(), start, "$$" if wide else "$")
        self._cut(end, m.end(), "$$" if wide else "$")
        for e in _ENTITY.finditer(inner):
            self._cut(start + e.start(), start + e.end(), html.unescape(e[0]))
        self.ranges.append(("formula", start, end))
        return None

    def _braces(self, at: int) -> int:
        """Place of the brace that closes one open at `at` - 1, or the line's end."""
        depth = 1
        for m in re.compile(r"\\.|[{}\n]").finditer(self.work, at):
            if m[0] == "{":
                depth += 1
            elif m[0] == "}":
                depth -= 1
                if not depth:
                    return m.start()
            elif m[0] == "\n" and self.work[m.end() : m.end() + 1] in ("\n", ""):
                return m.start()
        return len(self.work)

    def _latex(self) -> None:
        self._mask(_TEX_COMMENT, lambda m: self._cut(*m.span()))
        self._mask(_TEX_NOTE, lambda m: self._cut(*m.span()))
        self._mask(_TEX_DROP, lambda m: self._cut(*m.span()))
        closing: list[int] = []

        def head(m: re.Match) -> None:
            end = self._braces(m.end())
            self.ranges.append(("heading", m.end(), end))
            self._cut(*m.span(), "#" * (2 if m[1] == "section" else 1 if m[1] in ("part", "chapter") else 3) + " ")
            closing.append(end)

        def style(m: re.Match) -> None:
            closing.append(self._braces(m.end()))
            self._cut(*m.span())

        self._mask(_TEX_HEAD, head)
        self._mask(_TEX_LINK, style)
        self._mask(_TEX_STYLE, style)
        for at in closing:
            if at < len(self.work) and self.raw[at] == "}":
                self._cut(at, at + 1)
                self._hide(at, at + 1)
        self._show()
        if "\\item" in self.work:
            ends = sorted([m.start() for m in _TEX_ITEM.finditer(self.work)] + [m.start() for m in _TEX_ENV.finditer(self.work)] + [m.start() for m in _BREAK.finditer(self.work)] + [len(self.work)])

            def item(m: re.Match) -> None:
                self.ranges.append(("list_item", m.end(), ends[bisect_left(ends, m.end())]))
                self._cut(*m.span(), "- ")

            self._mask(_TEX_ITEM, item)
        self._mask(_TEX_ENV, lambda m: self._cut(*m.span()))
        self._mask(_TEX_SIGN, lambda m: self._cut(*m.span(), m[1] or "\n"))
        self.work = self.work.replace("~", " ")
        self.cells = [" " if c == "~" else c for c in self.cells]

    def _inline_links(self) -> None:
        if "[[" in self.work:
            self._mask(_WIKI_FILE, lambda m: self._cut(*m.span()))

            def link(m: re.Match) -> None:
                shown = m.span(2) if m[2] else m.span(1)
                self._cut(m.start(), shown[0])
                self._cut(shown[1], m.end())

            self.work = _WIKI_LINK.sub(lambda m: (setattr(self, "marked", True), link(m), GONE * (m.start(2 if m[2] else 1) - m.start()) + (m[2] or m[1]) + GONE * (m.end() - m.end(2 if m[2] else 1)))[2], self.work)
        if "{{" in self.work:
            self._templates()
        if "__" in self.work:
            self._mask(_MAGIC, lambda m: self._cut(*m.span()))
        if "](" in self.work:
            self._mask(_IMAGE, lambda m: self._cut(*m.span()))

            def shown(m: re.Match) -> str:
                self.marked = True
                self._cut(m.start(), m.start() + 1)
                self._cut(m.end(1), m.end())
                return GONE + m[1] + GONE * (m.end() - m.end(1))

            self.work = _LINK.sub(shown, self.work)
        if "]:" in self.work:
            self._mask(_DEFINITION, lambda m: self._cut(*m.span()))
        if "[^" in self.work:
            self._mask(_FOOTNOTE, lambda m: self._cut(*m.span()))
        if "''" in self.work:
            self._mask(_WIKI_MARK, lambda m: self._cut(*m.span()))
        if "{|" in self.work or "|}" in self.work or "\n|-" in self.work:
            self._mask(_TABLE, lambda m: self._cut(*m.span(), " "))

    def _templates(self) -> None:
        """Templates of any depth in one pass; some show their last part, the others go whole."""
        stack, found = [], []  # open ones: start, place after the last bar, whether a single brace stands in them
        for m in _BRACES.finditer(self.work):
            run, at = m[0], m.start()
            if run == "|":
                if stack:
                    stack[-1][1] = at + 1
            elif run[0] == "{":
                if len(run) % 2 and stack:
                    stack[-1][2] = True
                stack += [[k, 0, False] for k in range(at + len(run) % 2, m.end(), 2)]
            else:
                left = len(run)
                while left > 1 and stack:
                    start, last, broken = stack.pop()
                    left -= 2
                    if not broken:
                        found.append((start, m.end() - left, last))
                    elif stack:
                        stack[-1][2] = True
                if left and stack:
                    stack[-1][2] = True
        parts, at, gone = [], 0, 0
        for start, end, last in sorted(found):
            self.marked = True
            if start < gone:
                continue
            if last and _SHOWN.match(self.work, start):
                self._cut(start, last)
                self._cut(end - 2, end)
            else:
                self._cut(start, end)
                gone = end
            if start >= at:
                parts += [self.work[at:start], _SEEN.sub(GONE, self.work[start:end])]
                at = end
        self.work = "".join([*parts, self.work[at:]])

    def _blocks(self) -> None:
        """Headings, rules, list items and quotes at the start of lines, paragraph by paragraph."""
        low = 0
        for stop in [*_BREAK.finditer(self.work), None]:
            high = stop.start() if stop else len(self.work)
            if high > low:
                self._block(low, high)
            low = stop.end() if stop else high
        self._show()

    def _block(self, low: int, high: int) -> None:
        part = self.work[low:high]
        stripped = part.lstrip("\n" + GONE)
        if not stripped or stripped[0] not in "#=*+-_:;> \t0123456789" and not ("\n=" in part or "\n-" in part or "\n*" in part or "\n#" in part):
            return
        lines, at = [], low
        for line in part.split("\n"):
            lines.append((at, line))
            at += len(line) + 1
        full = [(s, x) for s, x in lines if x.strip(" \t\r" + GONE)]
        skip = -1
        hashes = sum(x.startswith("#") for _, x in full)
        items = sum(bool(_ITEM.match(x) or _WIKI_ITEM.match(x) and not _LINE_EMPHASIS.match(x)) for _, x in full)
        for n, (s, line) in enumerate(full):
            if s == skip:
                continue
            e = s + len(line)
            nxt = full[n + 1] if n + 1 < len(full) else None
            if nxt and not _ITEM.match(line) and line[0] not in "#=" and re.fullmatch(r"(?:={3,}|-{3,})[ \t]*", nxt[1]) and n == 0:
                self._heading(s, s + len(line.rstrip()), s, nxt[0], nxt[0] + len(nxt[1]), 1 if nxt[1][0] == "=" else 2)
                skip = nxt[0]
                continue
            if m := _WIKI_HEAD.match(line):
                self._heading(s + m.start(2), s + m.end(2), s, s + m.end(2), e, len(m[1]))
                continue
            if (m := _ATX.match(line)) and (hashes < 2 and (self.markdown or len(m[1]) > 1) or not self.wiki and (hashes < 2 or self.markdown)):
                self._heading(s + m.start(2), s + m.end(2), s, s + m.end(2), e, len(m[1]))
                continue
            if _RULE.match(line):
                if self.markdown or self.marked or len(full) == 1:
                    self._cut(s, e)
                    self.marked = self.marked or line.strip()[:3] == "---" and len(full) == 1
                continue
            m = _ITEM.match(line)
            if m and (items > 1 or self.wiki or self.markdown or m[2] and items == len(full) and not m[1]):
                if m[2] or items > 1 or re.match(r"[ \t]*\d{1,3}[.)]", line) and items == len(full):
                    self._item(s + m.end(), e, s)
                    continue
            if (m := _WIKI_ITEM.match(line)) and not _LINE_EMPHASIS.match(line) and (items == len(full) and (items > 1 or self.wiki) or self.wiki and line[0] in "*#"):
                self._item(s + m.end(), e, s)
                continue
            if line.startswith(":") and self.wiki:
                self._cut(s, s + len(line) - len(line.lstrip(":")))
            elif self.markdown and (m := _QUOTE.match(line)):
                self._cut(s, s + m.end())

    def _hide(self, start: int, end: int) -> None:
        self.hidden.append((start, end))

    def _show(self) -> None:
        """Take all hidden stretches out of sight at once."""
        parts, at = [], 0
        for start, end in sorted(self.hidden):
            if end > at:
                start = max(start, at)
                parts += [self.work[at:start], GONE * (end - start)]
                at = end
        self.work = "".join([*parts, self.work[at:]])
        self.hidden.clear()

    def _heading(self, start: int, end: int, first: int, tail: int, last: int, level: int) -> None:
        self.marked = True
        self.ranges.append(("heading", start, end))
        if first < start:
            self._cut(first, start, "#" * level + " ")
            self._hide(first, start)
        else:
            self.before[start] = "#" * level + " "
        self._cut(tail, last)
        self._hide(tail, last)

    def _item(self, start: int, end: int, first: int) -> None:
        self.marked = True
        self.ranges.append(("list_item", start, end))
        self._cut(first, start, "- ")
        self._hide(first, start)

    def _tags(self) -> None:
        """Take tags out, keep the ranges of headings and items, and drop what the tree scoring leaves out."""
        tags = [m for m in _TAG.finditer(self.work) if m[2].lower() in TAGS]
        if not tags:
            return
        self.marked = True
        for n, m in enumerate(tags):
            name, closes = m[2].lower(), bool(m[1])
            put = ""
            if name[0] == "h" and name[1:].isdigit() and not closes:
                k = n + 1
                while k < len(tags) and tags[k][2].lower() in INLINE:
                    k += 1
                end = tags[k].start() if k < len(tags) else len(self.work)
                blank = _BREAK.search(self.work, m.end())
                end = min(end, blank.start() if blank else end)
                self.ranges.append(("heading", m.end(), end))
                put = "\n" + "#" * int(name[1]) + " "
            elif name == "li" and not closes:
                k = n + 1
                while k < len(tags) and (tags[k][2].lower() in INLINE or tags[k][2].lower() in ("p", "br", "div", "pre")):
                    k += 1
                end = tags[k].start() if k < len(tags) else len(self.work)
                blank = _BREAK.search(self.work, m.end())
                end = min(end, blank.start() if blank else end)
                self.ranges.append(("list_item", m.end(), end))
                put = "\n- "
            elif name in ("br", "td", "th"):
                put = "\n" if name == "br" else " "
            elif name not in INLINE:
                put = "\n"
            self._cut(*m.span(), put)
        for start, end in dull(self.work, tags):
            self._cut(start, end)
            self.ranges = [r for r in self.ranges if not start <= r[1] < end]
        self.work = _TAG.sub(lambda m: (GONE * len(m[0])) if m[2].lower() in TAGS else m[0], self.work)

    def _inline_marks(self) -> None:
        w = self.work

        def emphasis(m: re.Match) -> str:
            mark = m[1] or m[3]
            if len(mark) == 1 and not (self.markdown or self.marked) and m[3]:
                return m[0]
            inner = m[2] or m[4]
            self.marked = True
            self._cut(m.start(), m.start() + len(mark))
            self._cut(m.end() - len(mark), m.end())
            return GONE * len(mark) + inner + GONE * len(mark)

        if "*" in w or "_" in w:
            self.work = _STRONG.sub(emphasis, self.work)
        if "`" in w:

            def tick(m: re.Match) -> None:
                self._cut(m.start(), m.start() + 1)
                self._cut(m.end() - 1, m.end())

            self._mask(_TICK, tick)

    def _entity(self, m: re.Match) -> bool | None:
        plain = html.unescape(m[0])
        if plain == m[0]:
            return False
        self._cut(*m.span(), plain)
        return None

    def elements(self) -> list[tuple[str, str]]:
        """(kind, content) of each distinct element, in order of place."""
        found = {}
        for kind, start, end in sorted(self.ranges, key=lambda r: (r[1], r[0])):
            content = "".join(self.cells[start:end])
            content = " ".join(content.replace("$", "").split() if kind in ("heading", "list_item") and FORMULA in self.work[start:end] else content.split())
            if content:
                found[kind, content] = None
        return list(found)

    def clean(self) -> tuple[str, list[int]]:
        """The clean text, and for each code point of the stored text where it begins in the clean one."""
        for kind, start, end in self.ranges:
            if kind in ("heading", "list_item"):  # one line each
                fresh = True
                for k in range(start, end):
                    if self.cells[k] in (" ", "\n", "\t"):
                        self.cells[k] = "" if fresh else " "
                    fresh = fresh and not self.cells[k]
        for at, sign in self.before.items():
            self.cells[at] = sign + self.cells[at]
        self.before.clear()
        if self.marked:  # at most one blank line, except in code
            code = [r[1:] for r in self.ranges if r[0] == "code"]
            breaks, k = 2, 0
            for k, c in enumerate(self.cells):
                if "\n" in c and not c.strip("\n"):
                    if breaks >= 2 and not any(s <= k < e for s, e in code):
                        self.cells[k] = ""
                    breaks += len(self.cells[k])
                elif c and not c.isspace():
                    breaks = 0
        starts = [0, *accumulate(map(len, self.cells))]
        return "".join(self.cells), starts


#: Least code points of a paragraph that passes points, of a sibling that reads like text, and the share of the best points that is enough.
LEAST_PARAGRAPH, LEAST_TEXT, ENOUGH = 25, 80, 0.2
#: Weight of a container named like page furniture, link density up to which text is text and structure is structure.
FURNITURE, FEW_LINKS, SOME_LINKS = 0.3, 0.25, 0.5


@dataclass
class Node:
    """A container with what its text is like."""

    start: int
    parent: int
    name: str
    weight: float
    end: int | None = None  # None while it isn't closed
    points: float = 0.0
    letters: int = 0  # of text, of links, and elements that are structure
    linked: int = 0
    structure: int = 0
    last: str = ""

    @property
    def density(self) -> float:
        return self.linked / self.letters if self.letters else 0.0

    @property
    def score(self) -> float:
        return self.points * (1 - self.density) * self.weight

    def stays(self, enough: float) -> bool:
        """Whether a sibling of the best container is kept; each reason counts by its strength times the name's weight."""
        if not self.letters:
            return True
        reads = self.density < FEW_LINKS if self.letters >= LEAST_TEXT else not self.linked and self.last in ".!?…。！？।"
        holds = self.structure > 0 and self.density <= SOME_LINKS
        return self.score >= enough or self.weight * max(reads, holds) >= 1


def outline(work: str, tags: list[re.Match]) -> list[Node]:
    """The tree of containers in one pass; node 0 is the whole text."""
    nodes, stack, stretch, link = [Node(0, -1, "", 1.0)], [0], [], False
    seen = [0, 0, 0, ""]  # letters, linked letters and structure so far, the last sign

    def paragraph() -> None:
        """The stretch of text since the last boundary passes its points up the tree."""
        text = "".join(stretch).strip()
        stretch.clear()
        if len(text) >= LEAST_PARAGRAPH:
            points, share, k = 1 + text.count(",") + min(len(text) / 100, 3), 1.0, stack[-1]
            for level in range(4):
                nodes[k].points += points * share
                k, share = nodes[k].parent, 1 / (level + 2)
                if k < 0:
                    break

    def take(piece: str) -> None:
        for n, part in enumerate(_BREAK.split(piece)):
            if n:
                paragraph()
            stretch.append(part)
            if text := part.strip():
                letters = len(text)
                seen[0] += letters
                seen[1] += letters * link
                seen[2] += CODE in text or FORMULA in text
                seen[3] = text[-1]

    def close(k: int, end: int | None) -> None:
        node = nodes[k]
        node.end, node.last = end, seen[3]
        node.letters, node.linked, node.structure = (now - then for now, then in zip(seen, (node.letters, node.linked, node.structure)))

    at = 0
    for m in tags:
        take(work[at : m.start()])
        at = m.end()
        name, closes = m[2].lower(), bool(m[1])
        if name == "a":
            link = not closes
        if name not in INLINE:
            paragraph()
        if not closes and (name in ("li", "pre", "math", "tr", "dt") or name[0] == "h" and name[1:].isdigit()):
            seen[2] += 1
        if name not in CONTAINERS:
            continue
        if not closes:
            weight = FURNITURE if name in ("nav", "aside", "footer", "form") or DULL.search(m[3] or "") else 1.0
            nodes.append(Node(m.start(), stack[-1], name, weight, letters=seen[0], linked=seen[1], structure=seen[2]))
            stack.append(len(nodes) - 1)
        elif (k := next((k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].name == name), 0)):
            for n in stack[k + 1 :]:
                close(n, None)
            close(stack[k], m.end())
            del stack[k:]
    take(work[at:])
    paragraph()
    for n in stack:
        close(n, None)
    return nodes


def dull(work: str, tags: list[re.Match]) -> list[tuple[int, int]]:
    """Ranges of the containers that tree scoring leaves out.

    Each paragraph passes 1 point, one a comma and up to 3 for its length to its container, half of that
    to the next and less to those above; link density and furniture names take their share. Containers that are never closed,
    and texts none of whose paragraphs give a point, are left alone.
    """
    nodes = outline(work, tags)
    best = max(range(len(nodes)), key=lambda k: (nodes[k].score, -k))
    if nodes[best].score <= 0:
        return []
    path, k = {best}, best
    while (k := nodes[k].parent) >= 0:
        path.add(k)
    enough = nodes[best].score * ENOUGH
    judged = (n for k, n in enumerate(nodes) if k not in path and n.parent in path and n.end is not None)
    return [(n.start, n.end) for n in judged if not n.stays(enough)]


ELEMENT = "array<struct<kind:string,content:string>>"
LINK = "array<struct<start_char:int,end_char:int,surface:string,target_title:string>>"


def _moved(links: list[dict] | None, doc: Document, clean: str, starts: list[int]) -> list[dict] | None:
    """Links with offsets into the clean text; their surface is what they mark there."""
    if links is None:
        return None
    out = []
    for link in links:
        if link is None:
            out.append(None)
            continue
        s, e, surface = link.get("start_char"), link.get("end_char"), link.get("surface")
        a = b = None
        if s is not None and e is not None and 0 <= s < e < len(starts):
            a, b = starts[s], starts[e]
            held = clean[a:b]
            a, b = a + len(held) - len(held.lstrip()), b - len(held) + len(held.rstrip())
        if a is None or b <= a:
            out.append({"start_char": None, "end_char": None, "surface": surface, "target_title": link.get("target_title")})
        else:
            out.append({"start_char": a, "end_char": b, "surface": clean[a:b], "target_title": link.get("target_title")})
    return out


def parse(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, marked, elements): what markup sets off in each document row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("content", pa.string())]))
        for batch in batches:
            marked, elements = [], []
            for t in batch.column(1).to_pylist():
                doc = Document(t or "")
                marked.append(doc.marked)
                elements.append([{"kind": k, "content": c} for k, c in doc.elements()])
            yield pa.record_batch([batch.column(0), pa.array(marked), pa.array(elements, kind)], ["doc_id", "marked", "elements"])

    return documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, f"doc_id bigint, marked boolean, elements {ELEMENT}")


def cleaned(documents: DataFrame, key: str = "doc_id", text: str = "text", links: str = "links") -> DataFrame:
    """(doc_id, clean_text, links, elements) of each document row; links mark their surfaces in the clean text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        element = pa.list_(pa.struct([("kind", pa.string()), ("content", pa.string())]))
        link = pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32()), ("surface", pa.string()), ("target_title", pa.string())]))
        for batch in batches:
            texts, moved, elements = [], [], []
            for t, given in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                doc = Document(t or "")
                clean, starts = doc.clean()
                texts.append(None if t is None else clean)
                moved.append(_moved(given, doc, clean, starts))
                elements.append([{"kind": k, "content": c} for k, c in doc.elements()])
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(moved, link), pa.array(elements, element)], ["doc_id", "clean_text", "links", "elements"])

    chosen = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(links).alias("links"))
    return chosen.mapInArrow(scan, f"doc_id bigint, clean_text string, links {LINK}, elements {ELEMENT}")
