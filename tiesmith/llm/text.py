"""Text folding shared by the operators here."""

from __future__ import annotations

import html
import re
import unicodedata

WORD = re.compile(r"[^\W_]+(?:\x00+[^\W_]+)*")
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)\b[^<>]*>|<!--.*?-->", re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]\w{1,30});")
_INVISIBLE = re.compile("[­͏؜ᅟ᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑](?:[ \t]*\r?\n[ \t]*)?(?=[^\W\d_])")
_TARGET = re.compile(r"(?<=\])\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*\)|(?<=\[\[)[^\[\]|\n]*\||\{\{\s*(?:lang|transl|nowrap)\s*\|(?:[^{}|]*\|)?|\{\{(?!\s*(?:lang|transl|nowrap)\s*\|)[^{}]*\}\}")
_FORMULA = re.compile(r"<math\b[^<>]*>.*?</math\s*>|\\\((?:(?!\\\(|\n[ \t\r]*\n).)+?\\\)|(?<![\\$\w])\$(?![\s$])(?:[^$\n]|\n(?![ \t\r]*\n))+(?<![\s\\])\$(?![\d$])", re.I | re.S)
_COMMAND = re.compile(r"\\href\{(?:[^{}\\]|\\.)*\}|\\(?:cite|ref|label|footnote)\{[^{}]*\}|\\[A-Za-z]+")
_MARKS = re.compile(r"(?<=[^\W_])(?:\*{1,3}|'{2,5}|_{1,2}|`)(?=[^\W_])")
_INLINE = {"a", "abbr", "b", "big", "cite", "em", "font", "i", "mark", "small", "span", "strong", "tt", "u"}


def _blank(match: re.Match) -> str:
    return " " * len(match[0])


def _join(match: re.Match) -> str:
    return "\x00" * len(match[0])


def _tag(match: re.Match) -> str:
    return ("\x00" if (match[1] or "").lower() in _INLINE else " ") * len(match[0])


def _entity(match: re.Match) -> str:
    plain = html.unescape(match[0])
    return plain.ljust(len(match[0]), "\x00") if len(plain) < len(match[0]) else match[0]


def settle(text: str) -> str:
    """`text` with markup, invisible characters and hyphenation taken out, code point for code point.

    What separates words becomes blanks and what stands within a word NULs, so that offsets
    into the result are offsets into `text`.
    """
    if "$" in text or "\\(" in text or "<math" in text:
        text = _FORMULA.sub(_blank, text)
    if "\\" in text:
        text = _COMMAND.sub(_blank, text)
    if "&" in text:
        text = _ENTITY.sub(_entity, text)
    if "<" in text:
        text = _TAG.sub(_tag, text)
    if "[" in text or "{{" in text:
        text = _TARGET.sub(_blank, text)
    if not text.isascii():
        text = _INVISIBLE.sub("\x00", text)
    if "*" in text or "''" in text or "_" in text or "`" in text:
        text = _MARKS.sub(_join, text)
    if "-" in text or "‐" in text or "‑" in text:
        text = _HYPHEN.sub(_join, text)
    return text


def fold(word: str) -> str:
    """A word without case, accents and compatibility forms."""
    word = word.replace("\x00", "")
    if word.isascii():
        return word.lower()
    word = unicodedata.normalize("NFKD", word)
    return "".join(c for c in word if not unicodedata.combining(c)).casefold()


def words(text: str | None) -> list[str]:
    """The folded words of plain text: runs of letters and digits of any script."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", text.casefold())
