import json

import pytest
from pyspark.sql import functions as F

from tiesmith.functions import claims, spans, text


def one(spark, column, **given):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("column", "given", "wanted"),
    [
        (lambda: text.title_from_article_url("u"), "https://en.example.org/wiki/Caf%C3%A9_de_Flore", "Café de Flore"), (lambda: text.title_from_article_url("u"), "https://x/wiki/C%2B%2B_and+more", "C++ and+more"),
        (lambda: text.url_tail("u"), "http://www.example.org/entity/Q42", "Q42"), (lambda: text.lenient_int("u"), " 17 ", 17), (lambda: text.lenient_int("u"), "17.5x", None),
        (lambda: text.title_from_href("u"), "./Some_One#Life", "Some One"), (lambda: text.title_from_href("u"), "./Red_Link?action=edit&redlink=1", "Red Link"), (lambda: text.title_from_href("u"), "#cite", None), (lambda: text.title_from_href("u"), "./#x", None), (lambda: text.title_from_href("u"), "https://x.y", None),
        (lambda: text.slug("u"), "Kaiser-Wilhelm Institute!", "kaiser-wilhelm-institute"), (lambda: text.slug("u"), "日本", "graph"), (lambda: text.dot_escape("u"), 'a"b\\c\nd', 'a\\"b\\\\c\\nd'), (lambda: text.html_escape("u"), '<a&"b">', "&lt;a&amp;&quot;b&quot;&gt;"),
        (lambda: text.revision_from_etag("u"), 'W/"12345/abc-def"', 12345), (lambda: text.revision_from_etag("u"), '"x1/y"', None), (lambda: text.short_label("u", 10), "short", "short"), (lambda: text.short_label("u", 10), "a few, words here", "a few…"), (lambda: text.short_label("u", 4), "unbroken", "unbr…"),
    ],
)
def test_strings(spark, column, given, wanted):
    assert one(spark, column(), u=given) == wanted


@pytest.mark.parametrize(("n", "shown"), [(0, "0.0 B"), (1023, "1023.0 B"), (1536, "1.5 KB"), (5 * 1024**3, "5.0 GB"), (2 * 1024**4, "2.0 TB")])
def test_human_bytes(spark, n, shown):
    assert one(spark, text.human_bytes("n"), n=n) == shown


def test_names(spark):
    assert one(spark, text.name_variants("n"), n="Ann Lee Ray (physicist)") == ["Ann Lee Ray", "Ray"]
    assert one(spark, text.name_variants("n"), n="Plato") == ["Plato"]
    assert one(spark, text.name_variants("n"), n="") == []


@pytest.mark.parametrize(("where", "word", "at"), [("\U0001f600 met Ray, Ray", "Ray", 6), ("Rayner met X-ray", "Ray", -1), ("Über ray", "Ray", -1), ("a (b) c", "(b)", 2), ("xéRay Ray", "Ray", 6)])
def test_word_position(spark, where, word, at):
    assert one(spark, text.word_position("t", "w"), t=where, w=word) == at


@pytest.mark.parametrize(("gender", "word"), [("Q6581097", "his"), ("Q6581072", "She"), (None, "She"), ("Q1", "She"), ])
def test_pronouns(spark, gender, word):
    t = "The theory: She saw his work"
    df = spark.range(1).select(text.pronoun_span(F.lit(t), F.lit(gender).cast("string")).alias("s")).first().s
    assert t[df.start : df.end] == word


def test_mask(spark):
    kind = "array<struct<start:int,end:int>>"
    run = lambda t, s, n: spark.range(1).select(spans.mask(F.lit(t), F.lit(s).cast(kind) if s is None else F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in s]).cast(kind), F.lit(n) if n is None else F.array(*[F.lit(x) for x in n]))).first()[0]
    t = "\U0001f600 Bohr met Ann Lee and Lee."
    assert run(t, [(2, 6), (2, 6), (90, 99), (5, 5)], ["Lee", "Ann Lee"]) == "\U0001f600 [PERSON] met [PERSON] and [PERSON]."
    assert run(t, None, None) == t


def test_islands_against_plain(spark):
    import itertools

    def plain(bits, bridge):
        runs, last = [], None
        for i, b in enumerate(bits):
            if b:
                if last is not None and i - last - 1 <= bridge:
                    runs[-1][1] = i + 1
                else:
                    runs.append([i, i + 1])
                last = i
        return [tuple(r) for r in runs]

    rows = [("".join(map(str, bits)),) for bits in itertools.product([0, 1], repeat=7)]
    df = spark.createDataFrame(rows, "b string")
    tokens = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda k: F.struct((k - 1).cast("int").alias("start"), k.cast("int").alias("end"), (F.substring(F.col("b"), k.cast("int"), F.lit(1)) == "1").alias("hit")))
    for r in df.select("b", spans.islands(tokens).alias("runs")).collect():
        assert [(x.start, x.end) for x in r.runs] == plain([c == "1" for c in r.b], 2)


def test_claims(spark):
    entry = lambda rank, **value: {"rank": rank, "mainsnak": {"datavalue": {"value": value}} if value else {}}
    lists = {
        "a": [entry("normal", id="Q1"), entry("preferred", id="Q2"), entry("deprecated", id="Q3")], "b": [entry("normal", id="Q1"), entry("normal", id="Q1"), entry("normal")],
        "c": [entry("normal"), entry("normal", time="-0384-01-01T00:00:00Z")], "d": [entry("normal", time="+1901-12-05T00:00:00Z")], "e": [],
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in lists.items()], "k string, j string").select("k", F.from_json("j", claims.CLAIMS).alias("c"))
    got = {r.k: (r.ids, r.year) for r in df.select("k", claims.claim_ids(F.col("c")).alias("ids"), claims.claim_year(F.col("c")).alias("year")).collect()}
    assert got == {"a": (["Q2"], None), "b": (["Q1"], None), "c": ([], -384), "d": ([], 1901), "e": ([], None)}


def test_run_id_depends_on_settings_only():
    assert claims.run_id({"a": 1, "b": 2}) == claims.run_id({"b": 2, "a": 1}) != claims.run_id({"a": 1, "b": 3})
