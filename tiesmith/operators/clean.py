"""Article HTML to sections with link spans, and a check that spans and surfaces agree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiesmith.schemas import SECTIONS

# Headings of sections that are left out.
DROP_SECTIONS = (
    "see also", "references", "external links", "further reading", "notes", "bibliography", "sources",
    "citations", "footnotes", "works cited", "publications", "selected publications", "external link", "notes and references",
)
# Elements that are taken out before any text is read.
DROP_SELECTORS = (
    "table", "figure", "figcaption", "style", "script", "link", "meta", "sup.mw-ref", "sup.reference",
    "[typeof~='mw:Extension/ref']", "[typeof~='mw:Extension/math']", "[typeof~='mw:Extension/references']",
    ".mw-editsection", ".navbox", ".metadata", ".hatnote", ".thumb", ".infobox", ".sidebar", ".ambox", ".mbox",
    "[role='navigation']", ".mw-empty-elt", ".shortdescription", ".noprint",
)
# Elements without content, and those that end an open paragraph.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = set("address article aside blockquote body div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html main nav ol p pre section table ul".split())
_SELECTOR = re.compile(r"(?P<tag>[a-z][\w-]*)?(?:\.(?P<cls>[\w-]+))?(?:\[(?P<attr>[\w-]+)(?:(?P<op>[~]?=)['\"]?(?P<value>[^'\"\]]*)['\"]?)?\])?$", re.I)


class Node:
    """An element with its attributes and its children, texts among them."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def words(self) -> str:
        """All text below, as one line."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(reversed(node.children))
        return " ".join(" ".join(p.split()) for p in out if p.strip())


class Selector:
    """tag, .class, tag.class, [attr], [attr=value] or [attr~=word], and a tag before brackets."""

    def __init__(self, text: str) -> None:
        m = _SELECTOR.match(text)
        if not m:
            raise ValueError(f"unsupported selector: {text}")
        self.tag, self.cls, self.attr, self.op, self.value = m["tag"], m["cls"], m["attr"], m["op"], m["value"]

    def matches(self, node: Node) -> bool:
        if self.tag and node.tag != self.tag.lower():
            return False
        if self.cls and self.cls not in node.attrs.get("class", "").split():
            return False
        if not self.attr:
            return True
        held = node.attrs.get(self.attr)
        return held is not None and (not self.op or (self.value in held.split() if self.op == "~=" else held == self.value))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_PARAGRAPH:
            self._close("p", within=ENDS_PARAGRAPH - {"p"})
        if tag == "li":
            self._close("li", within={"ul", "ol"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent or self.root

    def _close(self, tag: str, within: set[str] = frozenset()) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag and node.tag not in within:
            node = node.parent
        if node.tag == tag:
            self.at = node.parent

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


class _Paragraph:
    """Text with collapsed blanks and the spans of its links; a blank is written only before what follows it."""

    def __init__(self, link: Selector) -> None:
        self.link, self.parts, self.length, self.blank, self.links = link, [], 0, False, []

    def text(self, raw: str) -> None:
        body = " ".join(raw.split())
        if not body:
            self.blank = self.blank or bool(raw)
            return
        if self.blank or raw[0].isspace():
            self._space()
        self.parts.append(body)
        self.length += len(body)
        self.blank = raw[-1].isspace()

    def _space(self) -> None:
        if self.length:
            self.parts.append(" ")
            self.length += 1
        self.blank = False

    def read(self, node: Node) -> None:
        for child in node.children:
            if isinstance(child, str):
                self.text(child)
            elif self.link.matches(child):
                if self.blank:
                    self._space()
                start = self.length
                self.read(child)
                whole = "".join(self.parts)
                surface = whole[start : self.length]
                start += len(surface) - len(surface.lstrip())
                title = title_of(child.attrs.get("href", ""))
                if title and surface.strip():
                    self.links.append({"start": start, "end": start + len(surface.strip()), "surface": surface.strip(), "target_title": title})
            else:
                self.read(child)


def title_of(href: str) -> str | None:
    """Title that a relative article link addresses; None for other links."""
    if not href.startswith("./"):
        return None
    return unquote(href[2:].partition("#")[0].partition("?")[0]).replace("_", " ") or None


def parse_html(source: str | bytes | None, drop: tuple[str, ...] = DROP_SELECTORS, drop_sections: tuple[str, ...] = DROP_SECTIONS, section: str = "section", link: str = "a[rel~='mw:WikiLink']") -> list[dict]:
    """Sections {heading, text, links} of an article; the whole body is one if it has no sections."""
    if not source:
        return []
    builder = _Builder()
    builder.feed(source.decode("utf-8", "replace") if isinstance(source, bytes) else source)
    builder.close()
    gone = [Selector(s) for s in drop]
    for node in list(builder.root.walk()):
        node.children = [c for c in node.children if isinstance(c, str) or not any(s.matches(c) for s in gone)]
    body = next((n for n in builder.root.walk() if n.tag == "body"), builder.root)
    wanted, link_selector = Selector(section), Selector(link)
    tops, stack = [], [body]
    while stack:  # outermost sections only
        node = stack.pop()
        if node is not body and wanted.matches(node):
            tops.append(node)
        else:
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    out = []
    for top in tops or [body]:
        heads = [c for level in "23456" for c in top.children if isinstance(c, Node) and c.tag == f"h{level}"]
        heading = heads[0].words() if heads else ""
        if heading.strip().lower() in drop_sections:
            continue
        texts, links, offset = [], [], 0
        for node in top.walk():
            if node.tag != "p":
                continue
            held = _Paragraph(link_selector)
            held.read(node)
            text = "".join(held.parts)
            if text:
                links += [x | {"start": x["start"] + offset, "end": x["end"] + offset} for x in held.links]
                texts.append(text)
                offset += len(text) + 2
        if texts:
            out.append({"heading": heading, "text": "\n\n".join(texts), "links": links})
    return out


def sections_udf(**how) -> Column:
    """An Arrow UDF from HTML to sections."""

    @F.pandas_udf(SECTIONS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(lambda p: parse_html(p, **how))

    return run


def offset_problems(sections: Column) -> Column:
    """array<string>: link spans that don't cut their surface, or that begin or end with blanks."""
    def of(s: Column, i: Column) -> Column:
        held = lambda x: F.substring(s["text"], x["start"] + 1, x["end"] - x["start"])
        wrong = F.filter(s["links"], lambda x: (held(x) != x["surface"]) | held(x).rlike(r"(?U)^\s|\s$"))
        return F.transform(wrong, lambda x: F.concat(F.lit("section "), i.cast("string"), F.lit(": "), F.when(held(x) != x["surface"], "offset mismatch").otherwise("surrounding blanks")))

    return F.flatten(F.transform(sections, of))


def clean(pages: DataFrame, seed: DataFrame, log: DataFrame, strict: bool = True, **how) -> DataFrame:
    """documents from pages (qid, html), the seed's titles and the last successful fetches (qid, revision_id, fetched_at).

    Pages without text are left out; in strict mode a wrong span ends the job.
    """
    parsed = pages.select("qid", sections_udf(**how)(F.col("html")).alias("sections")).where(F.size("sections") > 0)
    named = parsed.join(seed.select("qid", F.nullif(F.col("title"), F.lit("")).alias("_title")), "qid", "left").join(log.select("qid", "revision_id", "fetched_at"), "qid", "left")
    from tiesmith.functions.text import permalink

    title = F.coalesce("_title", "qid")
    out = named.select(F.col("qid").alias("doc_id"), title.alias("title"), "qid", "revision_id", permalink(title, "revision_id").alias("url"), "fetched_at", F.lit("CC BY-SA 4.0").alias("license"), "sections")
    if not strict:
        return out
    problems = offset_problems(F.col("sections"))
    return out.withColumn("sections", F.when(F.size(problems) > 0, F.raise_error(F.concat(F.col("doc_id"), F.lit(": "), F.array_join(problems, "; "))).cast(SECTIONS)).otherwise(F.col("sections")))


def clean_counts(documents: DataFrame) -> DataFrame:
    sections = F.col("sections")
    return documents.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size(sections)).alias("sections"), F.sum(F.aggregate(sections, F.lit(0), lambda n, s: n + F.size(s["links"]))).alias("links"), F.sum(F.aggregate(sections, F.lit(0), lambda n, s: n + F.length(s["text"]))).alias("characters"))
