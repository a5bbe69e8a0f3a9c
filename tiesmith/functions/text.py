"""Scalar expressions over strings: titles, identifiers, labels, escapes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Third-person pronouns by gender item.
MALE, FEMALE = ("he", "him", "his"), ("she", "her", "hers")
GENDERS = {"Q6581097": MALE, "Q6581072": FEMALE}
PERMALINK = "https://en.wikipedia.org/w/index.php?title={title}&oldid={revision}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_decoded(c: Column | str) -> Column:
    """Percent codes decoded; a plus sign stays, and so do malformed strings."""
    c = _col(c)
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def title_from_article_url(url: Column | str) -> Column:
    """Last path part of an article's URL as a title."""
    return F.replace(url_decoded(F.element_at(F.split(_col(url), "/"), -1)), F.lit("_"), F.lit(" "))


def url_tail(url: Column | str) -> Column:
    """What follows the last slash: the identifier in an entity URL."""
    return F.element_at(F.split(_col(url), "/"), -1)


def lenient_int(c: Column | str) -> Column:
    """The integer that a string holds, or null."""
    return _col(c).try_cast("int")


def title_from_href(href: Column | str) -> Column:
    """Title of a relative article link without fragment and query; null for other links."""
    href = _col(href)
    bare = F.split_part(F.split_part(F.substring(href, 3, 1 << 30), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    return F.when(href.startswith("./") & (bare != ""), F.replace(url_decoded(bare), F.lit("_"), F.lit(" ")))


def name_variants(name: Column | str) -> Column:
    """Ways a person is named: without a closing parenthesis, then the last word; longest first."""
    full = F.trim(F.regexp_replace(_col(name), r"\s*\([^)]*\)\s*$", ""))
    last = F.element_at(F.split(full, r"\s+"), -1)
    return F.when(full.isNull() | (full == ""), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(full, last)))


def literal_pattern(c: Column | str) -> Column:
    """A regular expression that matches the string itself, whatever signs it holds."""
    return F.regexp_replace(_col(c), r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def word_position(text: Column | str, word: Column | str, ignore_case: bool = False) -> Column:
    """0-based code point of the first whole-word match, or -1.

    The text before the match is measured, as positions of regular expressions count UTF-16 units.
    """
    flags = "(?sui)" if ignore_case else "(?su)"
    pattern = F.concat(F.lit(flags + r"^(.*?)(?<![\p{L}\p{N}_])"), literal_pattern(word), F.lit(r"(?![\p{L}\p{N}_])"))
    text = _col(text)
    return F.when(F.regexp_like(text, pattern), F.length(F.call_function("regexp_extract", text, pattern, F.lit(1)))).otherwise(-1)


def pronoun_span(text: Column | str, gender: Column | str) -> Column:
    """struct<start,end> of the earliest pronoun that fits the gender; other genders try all six."""
    text, gender = _col(text), _col(gender)

    def earliest(words: tuple[str, ...]) -> Column:
        pattern = r"(?si)^(.*?)\b(" + "|".join(words) + r")\b"
        start = F.length(F.regexp_extract(text, pattern, 1))
        return F.when(text.rlike(pattern), F.struct(start.alias("start"), (start + F.length(F.regexp_extract(text, pattern, 2))).alias("end")))

    out = earliest(MALE + FEMALE)
    for item, words in GENDERS.items():
        out = F.when(gender == item, earliest(words)).otherwise(out)
    return out


def sentence_key(*parts: Column | str) -> Column:
    return F.concat_ws(":", *[_col(p).cast("string") for p in parts])


def short_label(text: Column | str, most: int = 28) -> Column:
    """At most `most` code points, cut at a blank, with an ellipsis."""
    text = _col(text)
    left = F.substring(text, 1, most)
    head = F.rtrim(F.regexp_replace(left, r"(?s) [^ ]*$", ""), F.lit(",.;:"))
    return F.when(F.length(text) <= most, text).when(head != "", F.concat(head, F.lit("…"))).otherwise(F.concat(F.rtrim(left), F.lit("…")))


def _replaced(c: Column | str, *pairs: tuple[str, str]) -> Column:
    out = _col(c)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def dot_escape(c: Column | str) -> Column:
    return _replaced(c, ("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"))


def html_escape(c: Column | str) -> Column:
    return _replaced(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def slug(c: Column | str) -> Column:
    """Lower-case letters and digits joined by hyphens; `graph` if none are left."""
    plain = F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(plain == "", "graph").otherwise(plain)


def edge_id(a: Column | str, b: Column | str) -> Column:
    return F.concat_ws("__", F.lit("edge"), _col(a), _col(b))


def node_id(qid: Column | str) -> Column:
    return F.concat_ws("__", F.lit("node"), _col(qid))


def box_id(a: Column | str, b: Column | str, kind: Column | str) -> Column:
    return F.concat_ws("__", F.lit("box"), _col(a), _col(b), _col(kind))


def svg_box_id(a: Column | str, b: Column | str, kind: Column | str) -> Column:
    return F.concat(F.lit("a_"), box_id(a, b, kind))


def human_bytes(n: Column | str) -> Column:
    """A number of bytes with one decimal and a unit."""
    n = _col(n).cast("double")
    shown = lambda power: F.format_string("%.1f", F.bround(n / 1024.0**power, 1))  # noqa: E731  halves go to the even digit
    out = F.concat(shown(4), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024.0 ** (power + 1), F.concat(shown(power), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n.isNotNull(), out)


def permalink(title: Column | str, revision: Column | str) -> Column:
    """Link to one revision; null without one."""
    title, revision = _col(title), _col(revision)
    return F.when(revision.isNotNull() & (revision != 0), F.concat(F.lit("https://en.wikipedia.org/w/index.php?title="), F.replace(title, F.lit(" "), F.lit("_")), F.lit("&oldid="), revision.cast("string")))


def revision_from_etag(etag: Column | str) -> Column:
    """Digits before the slash of a quoted entity tag."""
    part = F.split_part(F.split_part(_col(etag), F.lit('"'), F.lit(2)), F.lit("/"), F.lit(1))
    return F.when(part.rlike(r"^\d+$"), part.try_cast("bigint"))
