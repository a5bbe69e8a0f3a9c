"""All queries of the engine by name, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiesmith.functions import claims
from tiesmith.functions import spans as spn
from tiesmith.functions import text as txt
from tiesmith.operators import annotate, assemble, attributes, clean, density, fetching, graph, masking, mentions, resolve, seed, segment
from tiesmith.plans import star
from tiesmith.session import durable, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
SENTENCE = ["doc_id", "section_idx", "sent_idx"]
STOP = ["a", "and", "at", "in", "of", "the", "which", "who", "with"]


def query(*tables: str, sql: str | None = None):
    """Register a function of DataFrames under its name, with the tables it reads and its SQL."""

    def wrap(f):
        _QUERIES[f.__name__] = lambda spark, d: f(*(table(spark, d, t) for t in tables))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return wrap


def queries() -> dict[str, Query]:
    return _QUERIES | star.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | star.oracle_sql()


# --- seed and fetch -------------------------------------------------------------------------

_ORD = "logged_at, fetched_at, status, coalesce(error, ''), coalesce(url, ''), coalesce(revision_id, -1), coalesce(n_bytes, -1), coalesce(title, '')"


def _given(df: DataFrame, *columns: str) -> DataFrame:
    """Missing numbers as -1, so that both engines show them alike."""
    return df.withColumns({c: F.coalesce(c, F.lit(-1)) for c in columns})


def _logged(log: DataFrame) -> DataFrame:
    return log.distinct().withColumn("ord", F.expr(f"struct({_ORD})"))


@query(
    "fetch_log",
    sql=f"""WITH l AS (SELECT DISTINCT * FROM fetch_log)
    SELECT doc_id, arg_min_null(title, row({_ORD})) AS title, coalesce(arg_min(revision_id, row({_ORD})) FILTER (revision_id IS NOT NULL), -1) AS revision_id,
      arg_min(url, row({_ORD})) FILTER (url IS NOT NULL) AS url, coalesce(arg_min(n_bytes, row({_ORD})) FILTER (n_bytes IS NOT NULL), -1) AS n_bytes, count(*) - 1 AS variants
    FROM l WHERE doc_id IS NOT NULL GROUP BY doc_id""",
)
def gap_fill(log: DataFrame) -> DataFrame:
    return _given(seed.fill_gaps(_logged(log), "doc_id", ["ord"], ["title"], ["revision_id", "url", "n_bytes"]), "revision_id", "n_bytes")


@query(
    "entities",
    "documents",
    sql="""SELECT count(*) AS people, count(*) FILTER (birth_year IS NULL) AS without_birth_year, count(*) FILTER (death_year IS NULL) AS without_death_year,
    count(*) FILTER (gender IS NULL) AS without_gender, count(*) FILTER (n > 1) AS with_variants FROM entities LEFT JOIN (SELECT qid, count(*) AS n FROM documents GROUP BY 1) USING (qid)""",
)
def seed_quality(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """A person with several documents counts as one of several rows."""
    rows = documents.where("qid IS NOT NULL").groupBy("qid").agg((F.count(F.lit(1)) - 1).alias("variants"))
    return seed.seed_quality(entities.join(rows, "qid", "left").withColumn("variants", F.coalesce("variants", F.lit(0))))


@query(
    "entities",
    sql="""SELECT qid, coalesce(birth_year, -1) AS birth_year, coalesce(death_year, -1) AS death_year, gender, array_to_string(list_sort(list_distinct(occupations)), '|') AS occupations FROM entities""",
)
def metadata_collapse(entities: DataFrame) -> DataFrame:
    rows = entities.select("qid", "birth_year", "death_year", "gender", F.posexplode_outer("occupations").alias("n", "occupation"))
    flat = rows.withColumn("n", F.coalesce("n", F.lit(-1)))
    return _given(seed.collapse_metadata(flat, ["n"]), "birth_year", "death_year").withColumn("occupations", F.array_join("occupations", "|"))


@query(
    "fetch_log",
    sql=f"""SELECT doc_id, coalesce(revision_id, -1) AS revision_id, coalesce(n_bytes, -1) AS n_bytes, url FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row({_ORD}) DESC) AS r
    FROM (SELECT DISTINCT * FROM fetch_log WHERE status = 'ok')) WHERE r = 1 AND doc_id IS NOT NULL""",
)
def fetch_latest_ok(log: DataFrame) -> DataFrame:
    return _given(fetching.latest_ok(_logged(log).where("doc_id IS NOT NULL"), "doc_id", ["ord"]), "revision_id", "n_bytes").select("doc_id", "revision_id", "n_bytes", "url")


@query("entities", "documents", sql="SELECT qid, canonical_name FROM entities WHERE qid NOT IN (SELECT qid FROM documents WHERE qid IS NOT NULL)")
def fetch_todo(entities: DataFrame, documents: DataFrame) -> DataFrame:
    return fetching.still_to_do(entities.select("qid", "canonical_name"), documents.where("qid IS NOT NULL"), "qid")


@query(
    "fetch_log",
    sql=f"""SELECT doc_id, status, epoch_us(logged_at) AS logged_us FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row({_ORD}) DESC) AS r FROM (SELECT DISTINCT * FROM fetch_log)) WHERE r = 1 AND doc_id IS NOT NULL""",
)
def cache_last_wins(log: DataFrame) -> DataFrame:
    return fetching.last_of_key(_logged(log), "doc_id", ["ord"]).select("doc_id", "status", F.unix_micros("logged_at").alias("logged_us"))


@query(
    "documents",
    sql="""SELECT count(*) AS pages, CAST(sum(n) AS BIGINT) AS total, CAST(floor(avg(n)) AS BIGINT) AS mean, CAST(floor(median(n)) AS BIGINT) AS median, max(n) AS largest,
    round(avg(r), 4) AS ratio_mean, round(median(r), 4) AS ratio_median, round(sum(b) / sum(n), 4) AS ratio_weighted
    FROM (SELECT length(text) AS n, octet_length(encode(text)) AS b, octet_length(encode(text)) / nullif(length(text), 0) AS r FROM documents WHERE text IS NOT NULL)""",
)
def size_estimate(documents: DataFrame) -> DataFrame:
    sized = documents.where("text IS NOT NULL").select(F.length("text").cast("bigint").alias("n"), F.octet_length("text").cast("bigint").alias("b"))
    return fetching.size_estimate(sized, "n", "b")


@query(
    "entities",
    sql="SELECT qid FROM (SELECT qid, md5('7:' || qid) AS d FROM entities) ORDER BY d, qid LIMIT 40",
)
def seeded_sample(entities: DataFrame) -> DataFrame:
    return fetching.seeded_sample(entities.select("qid"), "qid", 40, 7)


# --- resolve --------------------------------------------------------------------------------


def _links(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode("links").alias("link_idx", "link")).select("doc_id", "link_idx", F.col("link.start_char").alias("start"), F.col("link.end_char").alias("end"), "link.surface", "link.target_title")


_LINKS = "links AS (SELECT doc_id, unnest(links) AS l, generate_subscripts(links, 1) - 1 AS link_idx FROM documents)"


@query(
    "documents",
    sql=f"WITH {_LINKS} SELECT l.target_title AS target_title, count(*) AS n, min(doc_id) AS first_doc FROM links WHERE l.target_title IS NOT NULL GROUP BY 1",
)
def target_frequency(documents: DataFrame) -> DataFrame:
    return resolve.target_frequency(_links(documents), ["doc_id", "link_idx"]).select("target_title", "n", F.col("first.doc_id").alias("first_doc"))


def _resolved(documents: DataFrame, entities: DataFrame) -> DataFrame:
    titles = documents.where("title IS NOT NULL").groupBy("title").agg(F.count(F.lit(1)).alias("link_instances"))
    cache = documents.where("title IS NOT NULL").groupBy("title").agg(F.max("qid").alias("qid"))
    claims = entities.where("birth_year IS NOT NULL").select("qid", F.col("in_seed").alias("is_human"))
    return resolve.resolve_titles(titles, cache, claims)


_RESOLVED = """resolved AS (SELECT t.title, t.qid, t.link_instances, CASE WHEN t.qid IS NULL THEN FALSE WHEN e.qid IS NOT NULL THEN e.in_seed END AS is_human, t.qid IS NULL AS no_item,
 (t.qid IS NULL OR e.qid IS NOT NULL) AS claims_resolved FROM (SELECT title, max(qid) AS qid, count(*) AS link_instances FROM documents WHERE title IS NOT NULL GROUP BY title) t
 LEFT JOIN (SELECT qid, in_seed FROM entities WHERE birth_year IS NOT NULL) e ON e.qid = t.qid)"""


@query("documents", "entities", sql=f"WITH {_RESOLVED} SELECT title, qid, coalesce(CAST(is_human AS VARCHAR), 'unknown') AS is_human, no_item, claims_resolved FROM resolved")
def tri_state_people(documents: DataFrame, entities: DataFrame) -> DataFrame:
    return _resolved(documents, entities).select("title", "qid", F.coalesce(F.col("is_human").cast("string"), F.lit("unknown")).alias("is_human"), "no_item", "claims_resolved")


@query(
    "documents",
    "entities",
    sql=f"""WITH {_RESOLVED} SELECT count(*) AS titles, count(*) FILTER (is_human) AS human_titles, count(*) FILTER (is_human IS NULL) AS unknown_titles, count(*) FILTER (no_item) AS red_titles,
    CAST(sum(link_instances) AS BIGINT) AS link_instances, CAST(sum(link_instances) FILTER (is_human) AS BIGINT) AS human_instances, round(sum(link_instances) FILTER (is_human) / sum(link_instances), 4) AS human_rate FROM resolved""",
)
def resolve_counts(documents: DataFrame, entities: DataFrame) -> DataFrame:
    return resolve.resolve_counts(_resolved(documents, entities))


@query(
    "documents",
    "entities",
    sql=f"""WITH {_LINKS}, t AS (SELECT DISTINCT l.target_title AS title FROM links WHERE l.target_title IS NOT NULL),
    c AS (SELECT canonical_name AS title, bool_or(birth_year IS NOT NULL) AS resolved FROM entities GROUP BY 1)
    SELECT count(*) AS targets, count(*) FILTER (c.resolved IS NULL) AS absent, count(*) FILTER (NOT c.resolved) AS open FROM t LEFT JOIN c USING (title)""",
)
def cache_guard(documents: DataFrame, entities: DataFrame) -> DataFrame:
    targets = _links(documents).where("target_title IS NOT NULL").select(F.col("target_title").alias("title"))
    return resolve.cache_coverage(targets, entities.select(F.col("canonical_name").alias("title"), F.col("birth_year").isNotNull().alias("claims_resolved")))


@query(
    "documents",
    sql="""SELECT title, array_to_string(w[:greatest(1, len(w) - 4)], '') AS resolved_title FROM (SELECT DISTINCT title, string_split(title, '') AS w FROM documents WHERE title IS NOT NULL)""",
)
def alias_chase(documents: DataFrame) -> DataFrame:
    """Every beginning of a title is an alias of the one that is a sign shorter; an older row that leads elsewhere is overridden."""
    titles = documents.where("title IS NOT NULL").select("title").distinct()
    cut = F.explode(F.sequence(F.lit(2), F.length("title"))).alias("n")
    steps = titles.where(F.length("title") > 1).select("title", cut).select(F.substring("title", F.lit(1), F.col("n")).alias("source"), F.substring("title", F.lit(1), F.col("n") - 1).alias("target"), F.lit(2).alias("ord"))
    return resolve.chase_aliases(titles, steps.unionByName(steps.select("source", F.lit("old").alias("target"), F.lit(1).alias("ord"))))


@query(
    "documents",
    sql=r"""SELECT doc_id, replace(url_decode(replace(split_part(split_part(u, '#', 1), '?', 1), '+', '%2B')), '_', ' ') AS title, u AS tail,
    coalesce(try_cast(split_part(u, 'oldid=', 2) AS INTEGER), -1) AS old_id,
    CASE WHEN revision_id IS NOT NULL AND revision_id <> 0 THEN 'https://en.wikipedia.org/w/index.php?title=' || replace(title, ' ', '_') || '&oldid=' || revision_id END AS permalink
    FROM (SELECT *, split_part(url, '/', -1) AS u FROM documents WHERE url IS NOT NULL)""",
)
def url_parts(documents: DataFrame) -> DataFrame:
    tail = txt.url_tail("url")
    return documents.where("url IS NOT NULL").select("doc_id", txt.title_from_href(F.concat(F.lit("./"), tail)).alias("title"), tail.alias("tail"), F.coalesce(txt.lenient_int(F.split_part(tail, F.lit("oldid="), F.lit(2))), F.lit(-1)).alias("old_id"), txt.permalink("title", "revision_id").alias("permalink"))


# --- mentions -------------------------------------------------------------------------------


def _once(found: DataFrame) -> DataFrame:
    """Mentions in the layout of the stages; repeated rows count once."""
    return found.withColumnRenamed("start_char", "start").withColumnRenamed("end_char", "end").distinct()


def _people(found: DataFrame) -> DataFrame:
    """Link mentions with their sentence's people; only what pairs need goes through the exchange."""
    once = found.select("mention_id", *SENTENCE, F.col("start_char").alias("start"), "entity_id", "mention_type").distinct()
    return mentions.with_people(once.where("mention_type = 'link' AND sent_idx IS NOT NULL"), once.where("mention_type = 'subject'"))


_PEOPLE = """m AS (SELECT DISTINCT * FROM mentions), links AS (SELECT l.*, s.entity_id AS subject_id FROM m l LEFT JOIN m s ON s.doc_id = l.doc_id AND s.mention_type = 'subject' WHERE l.mention_type = 'link' AND l.sent_idx IS NOT NULL),
counts AS (SELECT doc_id, section_idx, sent_idx, count(DISTINCT entity_id) AS linked, count(DISTINCT entity_id) + CASE WHEN max(subject_id) IS NOT NULL AND NOT bool_or(coalesce(entity_id = subject_id, FALSE)) THEN 1 ELSE 0 END AS people FROM links GROUP BY ALL),
people AS (SELECT * FROM links JOIN counts USING (doc_id, section_idx, sent_idx)),
pairs AS (SELECT doc_id, section_idx, sent_idx, subject_id AS head_entity_id, entity_id AS tail_entity_id, -1 AS head_start, start_char AS tail_start, 'subject_link' AS rule, people FROM people WHERE entity_id <> subject_id
 UNION ALL SELECT a.doc_id, a.section_idx, a.sent_idx, a.entity_id, b.entity_id, a.start_char, b.start_char, 'link_link', a.people FROM people a JOIN people b ON a.doc_id = b.doc_id AND a.section_idx = b.section_idx AND a.sent_idx = b.sent_idx
 WHERE a.people <= 6 AND a.start_char < b.start_char AND a.entity_id <> b.entity_id)"""


@query("mentions", sql=f"WITH {_PEOPLE} SELECT concat_ws(':', doc_id, section_idx, sent_idx, head_entity_id, tail_entity_id) AS candidate_id, doc_id, section_idx, sent_idx, head_entity_id, tail_entity_id, head_start, tail_start, rule, CAST(people AS INTEGER) AS people_in_sentence FROM pairs")
def candidate_pairs(found: DataFrame) -> DataFrame:
    pairs = mentions.candidate_pairs(durable(_people(found))).withColumn("head_start", F.coalesce("head_start", F.lit(-1)))
    return pairs.select("candidate_id", *SENTENCE, "head_entity_id", "tail_entity_id", "head_start", "tail_start", "rule", "people_in_sentence")


@query("mentions", sql=f"WITH {_PEOPLE} SELECT doc_id, CAST(sum(linked * (linked - 1) / 2) AS BIGINT) AS pairs FROM counts WHERE people > 2 GROUP BY doc_id")
def suppressed_pairs(found: DataFrame) -> DataFrame:
    return mentions.suppressed(_people(found), most_people=2)


@query("documents", "mentions", sql=f"WITH {_PEOPLE} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM pairs)")
def documents_without_pairs(documents: DataFrame, found: DataFrame) -> DataFrame:
    return mentions.without_pairs(documents, mentions.candidate_pairs(durable(_people(found))))


@query("mentions", sql="SELECT mention_type, link_method, count(*) AS mentions, count(DISTINCT doc_id) AS documents, count(DISTINCT entity_id) AS entities FROM (SELECT DISTINCT * FROM mentions) GROUP BY 1, 2")
def mention_counts(found: DataFrame) -> DataFrame:
    return mentions.mention_counts(found.distinct())


@query(
    "mentions",
    "entities",
    sql="""WITH m AS (SELECT DISTINCT * FROM mentions), d AS (SELECT DISTINCT entity_id, doc_id FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY doc_id) AS r FROM d)
    SELECT c.entity_id, c.canonical_name, coalesce(e.in_seed, FALSE) AS in_seed, c.mention_count, x.doc_count, f.doc_ids FROM
    (SELECT entity_id, count(*) AS mention_count, arg_min_null(CASE WHEN mention_type = 'link' THEN coalesce(n.canonical_name, surface) ELSE surface END, row(doc_id, coalesce(section_idx, -1), coalesce(start_char, -1))) AS canonical_name
      FROM m LEFT JOIN (SELECT qid, max(canonical_name) AS canonical_name FROM entities GROUP BY 1) n ON n.qid = m.entity_id GROUP BY 1) c
    JOIN (SELECT entity_id, count(*) AS doc_count FROM d GROUP BY 1) x USING (entity_id) JOIN (SELECT entity_id, string_agg(doc_id, ',' ORDER BY doc_id) AS doc_ids FROM r WHERE r <= 50 GROUP BY 1) f USING (entity_id)
    LEFT JOIN (SELECT DISTINCT qid, TRUE AS in_seed FROM entities WHERE in_seed) e ON e.qid = c.entity_id""",
)
def entity_rollup(found: DataFrame, entities: DataFrame) -> DataFrame:
    titles = entities.groupBy(F.col("qid").alias("entity_id")).agg(F.max("canonical_name").alias("_title"))  # the articles that links lead to
    named = _once(found).join(titles, "entity_id", "left").withColumn("name", F.when(F.col("mention_type") == "link", F.coalesce("_title", "surface")).otherwise(F.col("surface")))
    rolled = mentions.roll_up(named, entities.where("in_seed"))
    return rolled.withColumn("doc_ids", F.array_join(F.transform("doc_ids", lambda d: d.cast("string")), ","))


@query(
    "documents",
    "entities",
    "sentences",
    sql=f"""WITH {_LINKS}, s AS (SELECT DISTINCT doc_id, section_idx, sent_idx, start_char, end_char FROM sentences), h AS (SELECT canonical_name AS title, min(qid) AS entity_id FROM entities GROUP BY 1)
    SELECT x.doc_id, x.link_idx, h.entity_id, coalesce(s.section_idx, -1) AS section_idx, coalesce(s.sent_idx, -1) AS sent_idx FROM (SELECT doc_id, link_idx, l.start_char AS a, l.target_title AS t FROM links WHERE l.start_char IS NOT NULL) x
    JOIN h ON h.title = x.t LEFT JOIN s ON s.doc_id = x.doc_id AND s.start_char <= x.a AND x.a < s.end_char""",
)
def interval_containment(documents: DataFrame, entities: DataFrame, sentences: DataFrame) -> DataFrame:
    humans = entities.groupBy(F.col("canonical_name").alias("target_title")).agg(F.min("qid").alias("entity_id"))
    links = _links(documents).where("start IS NOT NULL").join(humans, "target_title").select("doc_id", "link_idx", "start", "entity_id")
    held = sentences.select(*SENTENCE, F.col("start_char").alias("start"), F.col("end_char").alias("end")).distinct()
    return _given(mentions.locate(links, held, ["doc_id"], "start", ["section_idx", "sent_idx"]), "section_idx", "sent_idx").drop("start")


# --- segment --------------------------------------------------------------------------------


@query(
    "documents",
    sql=r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS t, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
    o AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, CAST(coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, CAST(length(t) AS INTEGER) AS chars, t FROM p)
    SELECT doc_id, idx, start, chars FROM o WHERE regexp_matches(t, '[^\s\x{00A0}\x{3000}]')""",
)
def paragraph_offsets(documents: DataFrame) -> DataFrame:
    parts = documents.where("text IS NOT NULL").select("doc_id", F.explode(segment.paragraphs(F.col("text"))).alias("p"))
    return parts.select("doc_id", "p.idx", "p.start", F.length("p.text").alias("chars"))


def _sections(documents: DataFrame) -> DataFrame:
    return documents.where("text IS NOT NULL").select("doc_id", F.lit(0).alias("section_idx"), "text")


_S = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_CLOSING = r"[.!?]SIGNS[\"”’)\]]*" + _S + "+"
_ABBREVIATED = r"((?:^|[^\p{L}\p{N}_])(?:" + "|".join(a.replace(".", r"\.") for a in segment.ABBREVIATIONS) + r"|\p{Lu})" + _CLOSING.replace("SIGNS", "") + ")"
_UNITS = f"""WITH RECURSIVE p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS t, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS idx FROM documents WHERE text IS NOT NULL),
o AS (SELECT *, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM p),
m AS (SELECT doc_id, idx, base, regexp_replace(t, '({_CLOSING.replace("SIGNS", "+")})(["“(\\[¿¡]?[\\p{{Lu}}\\p{{Nd}}])', '\\1' || chr(1) || '\\2', 'g') AS t FROM o),
x AS (SELECT doc_id, idx, base, regexp_replace(regexp_replace(t, '{_ABBREVIATED}' || chr(1), '\\1', 'g'), '{_ABBREVIATED}' || chr(1), '\\1', 'g') AS t FROM m),
parts AS (SELECT doc_id, idx, base, unnest(string_split(t, chr(1))) AS t, generate_subscripts(string_split(t, chr(1)), 1) AS i FROM x),
placed AS (SELECT *, base + coalesce(sum(length(t)) OVER (PARTITION BY doc_id, idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, regexp_replace(t, '^{_S}+', '') AS r FROM parts),
s AS (SELECT doc_id, idx, pos + length(t) - length(r) AS a, regexp_replace(r, '{_S}+$', '') AS t, row_number() OVER (PARTITION BY doc_id, idx ORDER BY i) AS rn FROM placed WHERE r <> ''),
b AS (SELECT *, a + length(t) AS z, length(replace(t, ']', '')) - length(replace(t, '[', '')) AS more FROM s),
f AS (SELECT doc_id, idx, rn, a AS g, z, more AS balance, 0 AS merges FROM b WHERE rn = 1 UNION ALL
  SELECT b.doc_id, b.idx, b.rn, CASE WHEN f.balance > 0 AND f.merges < 4 THEN f.g ELSE b.a END, b.z, CASE WHEN f.balance > 0 AND f.merges < 4 THEN f.balance + b.more ELSE b.more END,
  CASE WHEN f.balance > 0 AND f.merges < 4 THEN f.merges + 1 ELSE 0 END FROM f JOIN b ON b.doc_id = f.doc_id AND b.idx = f.idx AND b.rn = f.rn + 1),
u AS (SELECT doc_id, idx, g, max(z) AS z FROM f GROUP BY 1, 2, 3)"""


@query("documents", sql=_UNITS + """ SELECT u.doc_id, 0 AS section_idx, CAST(row_number() OVER (PARTITION BY u.doc_id ORDER BY g) - 1 AS INTEGER) AS sent_idx, CAST(g AS INTEGER) AS start, CAST(z AS INTEGER) AS "end",
    substring(text, CAST(g AS BIGINT) + 1, CAST(z - g AS BIGINT)) AS text FROM u JOIN documents USING (doc_id)""")
def sentence_units(documents: DataFrame) -> DataFrame:
    return segment.segment(_sections(documents))


@query("documents", sql=_UNITS + " SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT doc_id) AS sections, count(DISTINCT (doc_id, idx)) AS paragraphs, count(*) AS sentences, (SELECT count(*) FROM b) - count(*) AS merges FROM u")
def segment_counts(documents: DataFrame) -> DataFrame:
    return segment.segment_counts(segment.units(_sections(documents)))


@query(
    "sentences",
    sql="""WITH RECURSIVE s AS (SELECT *, length(replace(text, ']', '')) - length(replace(text, '[', '')) AS b, row_number() OVER (PARTITION BY doc_id, section_idx ORDER BY start_char, end_char, text) AS rn
      FROM (SELECT DISTINCT doc_id, section_idx, start_char, end_char, text FROM sentences)),
    f AS (SELECT doc_id, section_idx, rn, start_char AS g, end_char, b AS balance, 0 AS merges FROM s WHERE rn = 1 UNION ALL
      SELECT s.doc_id, s.section_idx, s.rn, CASE WHEN f.balance > 0 AND f.merges < 4 THEN f.g ELSE s.start_char END, s.end_char, CASE WHEN f.balance > 0 AND f.merges < 4 THEN f.balance + s.b ELSE s.b END,
      CASE WHEN f.balance > 0 AND f.merges < 4 THEN f.merges + 1 ELSE 0 END FROM f JOIN s ON s.doc_id = f.doc_id AND s.section_idx = f.section_idx AND s.rn = f.rn + 1)
    SELECT doc_id, section_idx, g AS start, arg_max(end_char, rn) AS "end" FROM f GROUP BY 1, 2, 3""",
)
def bracket_merge(sentences: DataFrame) -> DataFrame:
    """Sentences of a section joined across open brackets."""
    rows = sentences.groupBy("doc_id", "section_idx").agg(F.array_sort(F.collect_set(F.struct(F.col("start_char").alias("start"), F.col("end_char").alias("end"), "text"))).alias("s"))
    return rows.select("doc_id", "section_idx", F.explode(segment.merge_brackets(F.col("s"), F.lit(""))).alias("m")).select("doc_id", "section_idx", "m.start", "m.end")


@query(
    "sentences",
    sql=r"""SELECT sentence_id, CASE WHEN regexp_matches(text, '(?si)\b(?:he|him|his|she|her|hers)\b') THEN CAST(length(regexp_extract(text, '(?si)^(.*?)\b(he|him|his|she|her|hers)\b', 1)) AS INTEGER) ELSE -1 END AS pronoun_start
    FROM (SELECT DISTINCT sentence_id, text FROM sentences)""",
)
def pronoun_scan(sentences: DataFrame) -> DataFrame:
    return sentences.select("sentence_id", "text").distinct().select("sentence_id", F.coalesce(txt.pronoun_span("text", F.lit(None).cast("string"))["start"], F.lit(-1)).alias("pronoun_start"))


@query(
    "entities",
    sql=r"""SELECT qid, CASE WHEN f = l THEN f ELSE f || '|' || l END AS variants FROM (SELECT qid, f, string_split_regex(f, '\s+')[-1] AS l FROM
    (SELECT qid, trim(regexp_replace(canonical_name, '\s*\([^)]*\)\s*$', '')) AS f FROM entities WHERE canonical_name IS NOT NULL))""",
)
def name_variants(entities: DataFrame) -> DataFrame:
    return entities.where("canonical_name IS NOT NULL").select("qid", F.array_join(txt.name_variants("canonical_name"), "|").alias("variants"))


# --- attributes and relations ---------------------------------------------------------------


def _spans(spans: DataFrame) -> DataFrame:
    """Attribute spans in the layout of the stages; repeated rows count once."""
    once = spans.select("span_id", "sentence_id", "candidate_id", F.lower("attr_type").alias("attr_type"), "value", "span", "detector", "pronoun_resolved").distinct()
    return once.withColumn("span", F.when(F.size("span") == 2, F.struct(F.col("span")[0].alias("start"), F.col("span")[1].alias("end"))))


def _candidates(candidates: DataFrame) -> DataFrame:
    pair = lambda c: F.when(F.size(c) == 2, F.struct(F.col(c)[0].alias("start"), F.col(c)[1].alias("end"))).alias(c)
    return candidates.select("candidate_id", "sentence_id", *SENTENCE, "sentence", "head_entity_id", "tail_entity_id", pair("head_span"), pair("tail_span"), "rule_name", "people_in_sentence").distinct()


@query("attribute_spans", sql="SELECT attr_type, count(*) AS spans FROM (SELECT DISTINCT span_id, lower(attr_type) AS attr_type FROM attribute_spans) GROUP BY 1")
def attribute_counts(spans: DataFrame) -> DataFrame:
    return attributes.attribute_counts(spans.select("span_id", F.lower("attr_type").alias("attr_type")).distinct())


_TOKENS = f"""s AS (SELECT DISTINCT sentence_id, text FROM sentences), w AS (SELECT sentence_id, unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) AS i FROM s),
o AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY sentence_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM w),
sp AS (SELECT DISTINCT sentence_id, span[1] AS a, span[2] AS b FROM attribute_spans WHERE span IS NOT NULL),
tok AS (SELECT o.sentence_id, o.i, o.off, o.t, length(o.t) AS n, regexp_matches(o.t, '[\\p{{L}}\\p{{N}}]') AND lower(o.t) NOT IN ({", ".join(f"'{w}'" for w in STOP)}) AS content,
 EXISTS (SELECT 1 FROM sp WHERE sp.sentence_id = o.sentence_id AND sp.a <= o.off AND o.off < sp.b) AS covered FROM o WHERE length(o.t) > 0)"""


def _tokenised(sentences: DataFrame, spans: DataFrame) -> DataFrame:
    stop = F.array(*[F.lit(w) for w in STOP])
    held = _spans(spans).where("span IS NOT NULL").groupBy("sentence_id").agg(F.collect_set("span").alias("spans"))
    once = sentences.select("sentence_id", "text").distinct().join(held, "sentence_id", "left")
    return once.select("sentence_id", "text", assemble.tokens(F.col("text"), stop).alias("tokens"), F.coalesce("spans", F.array().cast(assemble.SPANS)).alias("spans"))


@query("sentences", "attribute_spans", sql=f"WITH {_TOKENS} SELECT sentence_id, CASE WHEN count(*) FILTER (content) = 0 THEN 1.0 ELSE round(count(*) FILTER (content AND covered) / count(*) FILTER (content), 4) END AS coverage FROM tok GROUP BY 1")
def token_coverage(sentences: DataFrame, spans: DataFrame) -> DataFrame:
    return _tokenised(sentences, spans).where(F.size("tokens") > 0).select("sentence_id", F.round(assemble.coverage(F.col("tokens"), F.col("spans")), 4).alias("coverage"))


@query(
    "sentences",
    "attribute_spans",
    sql=f"""WITH {_TOKENS}, n AS (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY off) AS pos FROM tok), h AS (SELECT * FROM n WHERE content AND NOT covered),
    g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY sentence_id ORDER BY pos) <= 3 THEN 0 ELSE 1 END AS fresh FROM h), r AS (SELECT *, sum(fresh) OVER (PARTITION BY sentence_id ORDER BY pos) AS run FROM g)
    SELECT r.sentence_id, CAST(run AS INTEGER) AS run, substring(any_value(s.text), CAST(min(off) AS INTEGER) + 1, CAST(max(off + n) - min(off) AS INTEGER)) AS uncovered FROM r JOIN s USING (sentence_id) GROUP BY 1, 2""",
)
def uncovered_runs(sentences: DataFrame, spans: DataFrame) -> DataFrame:
    runs = _tokenised(sentences, spans).select("sentence_id", F.posexplode(assemble.uncovered(F.col("text"), F.col("tokens"), F.col("spans"))).alias("n", "uncovered"))
    return runs.select("sentence_id", (F.col("n") + 1).alias("run"), "uncovered")


def _records(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    none = F.lit(None).cast(attributes.PLACE)
    return assemble.relations(_candidates(candidates).withColumn("head", none).withColumn("tail", none), _spans(spans), None, STOP)


def _located(candidates: DataFrame, entities: DataFrame, sentences: DataFrame) -> DataFrame:
    return attributes.with_participants(_candidates(candidates), entities, sentences.select("sentence_id", F.col("start_char").alias("start")))


_DISTINCT = "SELECT DISTINCT candidate_id, sentence_id, doc_id, section_idx, sent_idx, sentence, head_entity_id, tail_entity_id, head_span, tail_span, rule_name, people_in_sentence FROM candidates"
_WHOLE = r"""CASE WHEN sp IS NULL AND {v} <> '' AND regexp_matches(t, '(?s)(?:^|[^\p{{L}}\p{{N}}_])' || regexp_escape({v}) || '(?:$|[^\p{{L}}\p{{N}}_])')
  THEN length(regexp_extract(t, '(?s)^(.*?(?:^|[^\p{{L}}\p{{N}}_]))' || regexp_escape({v}) || '(?:$|[^\p{{L}}\p{{N}}_])', 1)) ELSE -1 END"""
_LOCATED = rf"""c AS (SELECT *, row_number() OVER () AS rid FROM ({_DISTINCT})), st AS (SELECT sentence_id, min(start_char) AS base FROM sentences GROUP BY 1),
side AS (SELECT rid, 'head' AS side, sentence AS t, CASE WHEN len(head_span) = 2 THEN head_span END AS sp, head_entity_id AS e, coalesce(base, 0) AS base FROM c LEFT JOIN st USING (sentence_id)
  UNION ALL SELECT rid, 'tail', sentence, CASE WHEN len(tail_span) = 2 THEN tail_span END, tail_entity_id, coalesce(base, 0) FROM c LEFT JOIN st USING (sentence_id)),
named AS (SELECT side.*, trim(regexp_replace(n.canonical_name, '\s*\([^)]*\)\s*$', '')) AS f, CASE n.gender WHEN 'Q6581097' THEN 'he|him|his' WHEN 'Q6581072' THEN 'she|her|hers' ELSE 'he|him|his|she|her|hers' END AS w
  FROM side LEFT JOIN (SELECT qid, max(canonical_name) AS canonical_name, max(gender) AS gender FROM entities GROUP BY 1) n ON n.qid = side.e),
tried AS (SELECT *, string_split_regex(f, '\s+')[-1] AS l FROM named), sought AS (SELECT *, {_WHOLE.format(v="f")} AS pf, {_WHOLE.format(v="l")} AS pl, sp IS NULL AND regexp_matches(t, '(?si)\b(?:' || w || ')\b') AS spoken FROM tried),
place AS (SELECT rid, side, t, CASE WHEN sp IS NOT NULL THEN CASE WHEN sp[1] >= base AND sp[1] < sp[2] AND sp[2] - base <= length(t) THEN 'span' END WHEN pf >= 0 OR pl >= 0 THEN 'name' WHEN spoken THEN 'pronoun' END AS method,
  CASE WHEN sp IS NOT NULL THEN sp[1] - base WHEN pf >= 0 THEN pf WHEN pl >= 0 THEN pl ELSE length(regexp_extract(t, '(?si)^(.*?)\b(?:' || w || ')\b', 1)) END AS a,
  CASE WHEN sp IS NOT NULL THEN sp[2] - base WHEN pf >= 0 THEN pf + length(f) WHEN pl >= 0 THEN pl + length(l) ELSE length(regexp_extract(t, '(?si)^(.*?\b(?:' || w || '))\b', 1)) END AS b FROM sought)"""


_RECORDS = """c AS (SELECT DISTINCT candidate_id, sentence_id, sentence, head_entity_id, tail_entity_id, head_span, tail_span, rule_name, people_in_sentence FROM candidates),
a AS (SELECT DISTINCT span_id, sentence_id, candidate_id, lower(attr_type) AS attr_type, value FROM attribute_spans),
r AS (SELECT c.*, a.attr_type, a.value FROM c LEFT JOIN a ON (a.candidate_id IS NULL AND a.sentence_id = c.sentence_id) OR a.candidate_id = c.candidate_id)"""


@query("candidates", "attribute_spans", sql=f"WITH {_RECORDS} SELECT candidate_id AS relation_id, count(value) FILTER (attr_type IS NOT NULL) AS valued, count(attr_type) AS n_attributes FROM r GROUP BY 1")
def relation_records(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """Attributes of all records of an id; a repeated id gives each of its rows all spans."""
    flat = _records(candidates, spans).select("relation_id", F.size("attributes").alias("n"), F.size(F.filter("attributes", lambda a: a["value"].isNotNull())).alias("v"))
    return flat.groupBy("relation_id").agg(F.sum("v").alias("valued"), F.sum("n").alias("n_attributes"))


@query(
    "candidates",
    "attribute_spans",
    sql=f"""WITH {_RECORDS} SELECT DISTINCT candidate_id AS relation_id FROM r WHERE attr_type = 'institution' AND contains(lower(value), 'university') AND head_entity_id <> '' AND tail_entity_id <> ''""",
)
def institution_filter(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    kept, low = assemble.split_by_coverage(_records(candidates, spans))
    return graph.complete(graph.at_institution(graph.pool(kept, low), "University")).select("relation_id").distinct()


@query(
    "candidates",
    "attribute_spans",
    "entities",
    "sentences",
    sql=f"""WITH {_LOCATED},
    a AS (SELECT DISTINCT sentence_id, candidate_id, span[1] AS a, span[2] AS b FROM attribute_spans WHERE span IS NOT NULL), sp AS (SELECT c.rid, a.a, a.b FROM c JOIN a ON a.candidate_id IS NULL AND a.sentence_id = c.sentence_id
      UNION ALL SELECT c.rid, a.a, a.b FROM c JOIN a ON a.candidate_id = c.candidate_id UNION ALL SELECT rid, a, b FROM place WHERE method IS NOT NULL),
    w AS (SELECT rid, unnest(string_split(sentence, ' ')) AS t, generate_subscripts(string_split(sentence, ' '), 1) AS i FROM c), o AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM w),
    k AS (SELECT rid, off FROM o WHERE regexp_matches(t, '[\\p{{L}}\\p{{N}}]') AND lower(t) NOT IN ({", ".join(f"'{w}'" for w in STOP)})),
    v AS (SELECT k.rid, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM sp WHERE sp.rid = k.rid AND sp.a <= k.off AND k.off < sp.b)) AS h FROM k GROUP BY 1),
    q AS (SELECT rid, bool_or(coalesce(method = 'pronoun', FALSE)) AS q FROM place GROUP BY 1),
    r AS (SELECT c.rid, q, CASE WHEN v.n IS NULL THEN 1.0 ELSE round(v.h / v.n, 4) END AS coverage FROM c LEFT JOIN v USING (rid) JOIN q USING (rid))
    SELECT count(*) AS records, count(*) FILTER (coverage < 0.5) AS low, round(count(*) FILTER (coverage < 0.5) / count(*), 4) AS low_rate, round(avg(coverage), 4) AS mean_coverage, round(count(*) FILTER (q) / count(*), 4) AS pronoun_rate FROM r""",
)
def relation_split(candidates: DataFrame, spans: DataFrame, entities: DataFrame, sentences: DataFrame) -> DataFrame:
    return assemble.coverage_counts(assemble.relations(_located(candidates, entities, sentences), _spans(spans), None, STOP))


@query("candidates", "entities", "sentences", sql=f"WITH {_LOCATED} SELECT rule_name, coalesce(h.method, 'none') AS head, coalesce(t.method, 'none') AS tail, count(*) AS pairs FROM c JOIN place h ON h.rid = c.rid AND h.side = 'head' JOIN place t ON t.rid = c.rid AND t.side = 'tail' GROUP BY 1, 2, 3")
def participants(candidates: DataFrame, entities: DataFrame, sentences: DataFrame) -> DataFrame:
    """Where both participants of each pair stand in their sentence, and how they were found."""
    found = _located(candidates, entities, sentences)
    return found.groupBy("rule_name", F.coalesce("head.method", F.lit("none")).alias("head"), F.coalesce("tail.method", F.lit("none")).alias("tail")).agg(F.count(F.lit(1)).alias("pairs"))


@query("candidates", "entities", "sentences")
def detected_attributes(candidates: DataFrame, entities: DataFrame, sentences: DataFrame) -> DataFrame:
    """Named and action spans by the default annotator, over the distinct sentences of all pairs."""
    pairs = _candidates(candidates)
    annotated = durable(annotate.annotate(pairs.select("sentence_id", F.col("sentence").alias("text"))))
    located = _located(candidates, entities, sentences)
    return attributes.named_spans(annotated).unionByName(attributes.action_spans(located, annotated))


# --- graph ----------------------------------------------------------------------------------


@query("candidates", sql="SELECT least(head_entity_id, tail_entity_id) AS a, greatest(head_entity_id, tail_entity_id) AS b, count(*) AS n_relations FROM (SELECT DISTINCT candidate_id, sentence_id, sentence, head_entity_id, tail_entity_id, head_span, tail_span, rule_name, people_in_sentence FROM candidates) WHERE head_entity_id <> tail_entity_id GROUP BY 1, 2")
def edge_collapse(candidates: DataFrame) -> DataFrame:
    who = lambda c: F.struct(F.col(c).alias("mention_id"), F.col(c).alias("qid"))
    records = _candidates(candidates).select(F.col("candidate_id").alias("relation_id"), "sentence_id", "sentence", F.array(who("head_entity_id"), who("tail_entity_id")).alias("participants"), F.array().cast(assemble.ATTRIBUTE).alias("attributes"))
    return graph.edges(records, ["sentence_id", "relation_id"]).select("a", "b", "n_relations")


@query(
    "candidates",
    "entities",
    sql="""WITH q AS (SELECT DISTINCT unnest([head_entity_id, tail_entity_id]) AS qid FROM candidates), e AS (SELECT qid, max(canonical_name) AS n FROM entities GROUP BY 1)
    SELECT q.qid, coalesce(e.n, q.qid) AS label, '  "' || q.qid || '" [id="node__' || q.qid || '", label="' || replace(replace(coalesce(e.n, q.qid), '\\', '\\\\'), '"', '\\"') || '"];' AS line FROM q LEFT JOIN e USING (qid)""".replace("'\\\\'", "chr(92)").replace("'\\\\\\\\'", "chr(92) || chr(92)").replace("'\\\\\"'", "chr(92) || '\"'"),
)
def graph_nodes(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    who = lambda c: F.struct(F.col(c).alias("mention_id"), F.col(c).alias("qid"))
    found = graph.nodes(candidates.select(F.array(who("head_entity_id"), who("tail_entity_id")).alias("participants")), entities)
    return found.join(graph.node_lines(found), "qid")


_DOT = lambda c: f"replace(replace(replace({c}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n')"
_HTML = lambda c: f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_SHORT = lambda c, n: f"CASE WHEN length({c}) <= {n} THEN {c} WHEN rtrim(regexp_replace(left({c}, {n}), '(?s) [^ ]*$', ''), ',.;:') <> '' THEN rtrim(regexp_replace(left({c}, {n}), '(?s) [^ ]*$', ''), ',.;:') || '…' ELSE rtrim(left({c}, {n})) || '…' END"
_BOX = lambda kind: (
    f"""CASE WHEN {kind} IS NULL THEN '' ELSE '<TD ID="box__' || {_HTML("a")} || '__' || {_HTML("b")} || '__{kind}" TOOLTIP="{kind.capitalize()}: ' || {_HTML(kind)} || '" BGCOLOR="{graph.COLOURS[kind]}"><FONT COLOR="{graph.PAGE["box"]}" POINT-SIZE="9">' || {_HTML(_SHORT(kind, graph.BOX_CHARS))} || '</FONT></TD>' END"""
)
_FIRST = ", ".join(f"arg_min_null(value, row(own, pos, value IS NOT NULL, value)) FILTER (attr_type = '{kind}') AS {kind}" for kind in graph.COLOURS)


@query(
    "candidates",
    "attribute_spans",
    "entities",
    sql=f"""WITH c AS (SELECT *, row_number() OVER () AS rid FROM ({_DISTINCT})),
    a AS (SELECT DISTINCT span_id, sentence_id, candidate_id, lower(attr_type) AS attr_type, value, coalesce(CASE WHEN len(span) = 2 THEN span[1] END, -1) AS pos, detector, pronoun_resolved FROM attribute_spans),
    r AS (SELECT c.rid, a.attr_type, a.value, a.pos, a.candidate_id IS NOT NULL AS own FROM c JOIN a ON a.candidate_id IS NULL AND a.sentence_id = c.sentence_id UNION ALL SELECT c.rid, a.attr_type, a.value, a.pos, TRUE FROM c JOIN a ON a.candidate_id = c.candidate_id),
    kept AS (SELECT c.*, least(head_entity_id, tail_entity_id) AS a, greatest(head_entity_id, tail_entity_id) AS b FROM c WHERE head_entity_id <> '' AND tail_entity_id <> '' AND head_entity_id <> tail_entity_id
      AND rid IN (SELECT rid FROM r WHERE attr_type = 'institution' AND contains(lower(value), 'university'))),
    e AS (SELECT a, b, arg_min(rid, row(sentence_id, candidate_id)) AS rid, string_agg(sentence, chr(10) ORDER BY sentence_id, candidate_id, sentence) AS tip FROM kept GROUP BY 1, 2),
    v AS (SELECT rid, {_FIRST} FROM r GROUP BY 1), x AS (SELECT e.a, e.b, tip, {" || ".join(map(_BOX, graph.COLOURS))} AS boxes FROM e LEFT JOIN v USING (rid))
    SELECT a, b, '  "' || {_DOT("a")} || '" -- "' || {_DOT("b")} || '" [id="edge__' || {_DOT("a")} || '__' || {_DOT("b")} || '", ' || CASE WHEN boxes = '' THEN 'label=""' ELSE 'label=<{graph.BOX_TABLE[0]}' || boxes || '{graph.BOX_TABLE[1]}>' END || ', tooltip="' || {_DOT("tip")} || '"];' AS line FROM x""",
)
def graph_lines(candidates: DataFrame, spans: DataFrame, entities: DataFrame) -> DataFrame:
    """DOT lines of the edges that touch a university."""
    records = graph.complete(graph.at_institution(_records(candidates, spans), "university"))
    found = graph.edges(records, ["sentence_id", "relation_id"]).join(graph.tooltips(records, ["sentence_id", "relation_id"]), ["a", "b"])
    return graph.edge_lines(found)


@query(
    "documents",
    sql=r"""SELECT doc_id, CASE WHEN length(title) <= 12 THEN title WHEN rtrim(regexp_replace(left(title, 12), ' [^ ]*$', ''), ',.;:') <> '' THEN rtrim(regexp_replace(left(title, 12), ' [^ ]*$', ''), ',.;:') || '…' ELSE rtrim(left(title, 12)) || '…' END AS short,
    CASE WHEN trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'graph' ELSE trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') END AS slug,
    CASE WHEN n_chars < 1024 THEN printf('%.1f B', n_chars::DOUBLE) WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024.0::DOUBLE) ELSE printf('%.1f MB', n_chars / 1048576.0::DOUBLE) END AS bytes,
    replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html FROM documents WHERE title IS NOT NULL AND n_chars IS NOT NULL""",
)
def labels(documents: DataFrame) -> DataFrame:
    return documents.where("title IS NOT NULL AND n_chars IS NOT NULL").select("doc_id", txt.short_label("title", 12).alias("short"), txt.slug("title").alias("slug"), txt.human_bytes("n_chars").alias("bytes"), txt.html_escape("title").alias("html"))


# --- masking, embedding, clusters -----------------------------------------------------------


@query("candidates", sql="SELECT doc_id, section_idx, sent_idx, concat_ws(':', doc_id, section_idx, sent_idx) AS sentence_id, min(sentence) AS sentence FROM candidates GROUP BY 1, 2, 3")
def dedup_sentences(candidates: DataFrame) -> DataFrame:
    return masking.distinct_sentences(candidates)


_NAME = r"(^|[^\p{L}\p{N}_])' || regexp_escape({v}) || '($|[^\p{L}\p{N}_])"
_MASKED = "regexp_replace(regexp_replace({t}, '" + _NAME + "', '\\1[PERSON]\\2', 'g'), '" + _NAME + "', '\\1[PERSON]\\2', 'g')"


def _without(text: str, name: str) -> str:
    """SQL of a text without a name as a whole word; twice, as neighbours share the sign between them."""
    return f"CASE WHEN {name} <> '' THEN " + _MASKED.replace("{t}", text).replace("{v}", name) + f" ELSE {text} END"


@query(
    "candidates",
    "mentions",
    "sentences",
    "entities",
    sql=rf"""WITH RECURSIVE once AS (SELECT doc_id, concat_ws(':', doc_id, section_idx, sent_idx) AS sentence_id, min(sentence) AS t FROM candidates GROUP BY doc_id, section_idx, sent_idx),
    st AS (SELECT sentence_id, min(start_char) AS base FROM sentences GROUP BY 1), m AS (SELECT DISTINCT * FROM mentions),
    sp AS (SELECT DISTINCT sentence_id, start_char - base AS a, end_char - base AS b FROM m JOIN st ON st.sentence_id = concat_ws(':', doc_id, section_idx, sent_idx) WHERE mention_type = 'link'),
    good AS (SELECT sp.*, row_number() OVER (PARTITION BY sentence_id ORDER BY a DESC, b DESC) AS r FROM sp JOIN once USING (sentence_id) WHERE a >= 0 AND a < b AND b <= length(t)),
    cut AS (SELECT sentence_id, doc_id, t, 0 AS r FROM once UNION ALL SELECT c.sentence_id, c.doc_id, substring(c.t, 1, g.a) || '[PERSON]' || substring(c.t, g.b + 1), g.r FROM cut c JOIN good g ON g.sentence_id = c.sentence_id AND g.r = c.r + 1),
    done AS (SELECT sentence_id, any_value(doc_id) AS doc_id, arg_max(t, r) AS t FROM cut GROUP BY 1),
    who AS (SELECT doc_id, max(coalesce(e.canonical_name, surface)) AS n FROM m LEFT JOIN (SELECT qid, max(canonical_name) AS canonical_name FROM entities GROUP BY 1) e ON e.qid = m.entity_id WHERE mention_type = 'subject' GROUP BY 1),
    v AS (SELECT doc_id, coalesce(f, '') AS f, coalesce(string_split_regex(f, '\s+')[-1], '') AS l FROM (SELECT doc_id, trim(regexp_replace(n, '\s*\([^)]*\)\s*$', '')) AS f FROM who)),
    whole AS (SELECT sentence_id, {_without("t", "coalesce(f, '')")} AS t, coalesce(l, '') AS l FROM done LEFT JOIN v USING (doc_id))
    SELECT sentence_id, {_without("t", "l")} AS masked_sentence FROM whole""",
)
def masked_sentences(candidates: DataFrame, found: DataFrame, sentences: DataFrame, entities: DataFrame) -> DataFrame:
    once = _once(found)
    spans = masking.people_spans(once, sentences.select("sentence_id", F.col("start_char").alias("start")))
    return masking.masked(masking.distinct_sentences(candidates), spans, masking.subject_names(once, entities)).select("sentence_id", "masked_sentence")


@query(
    "embeddings",
    sql="""WITH f AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, avg(v) AS m FROM f GROUP BY 1, 2),
    x AS (SELECT f.label, f.vec_id, round(sqrt(sum((v - m) * (v - m))), 6) AS distance FROM f JOIN m ON m.label = f.label AND m.d = f.d GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM x) SELECT label, CAST(rank AS INTEGER) AS rank, vec_id, round(distance, 4) AS distance FROM r WHERE rank <= 5""",
)
def exemplars(vectors: DataFrame) -> DataFrame:
    return density.exemplars(vectors, "vec_id", "label", "embedding").withColumn("distance", F.round("distance", 4))


@query(
    "embeddings",
    sql="""WITH l AS (SELECT t AS threshold, CASE WHEN embedding[1] < t THEN -1 ELSE label END AS cluster_id FROM embeddings, (SELECT unnest([-0.5, 0.0, 0.5])::DOUBLE AS t)), s AS (SELECT threshold, cluster_id, count(*) AS n FROM l GROUP BY 1, 2)
    SELECT threshold, CAST(sum(n) AS BIGINT) AS n_sentences, count(*) FILTER (cluster_id <> -1) AS n_clusters, CAST(coalesce(sum(n) FILTER (cluster_id = -1), 0) AS BIGINT) AS n_noise, round(coalesce(sum(n) FILTER (cluster_id = -1), 0) / sum(n), 4) AS noise_fraction,
    coalesce(max(n) FILTER (cluster_id <> -1), 0) AS largest_cluster_size, round(coalesce(max(n) FILTER (cluster_id <> -1), 0) / sum(n), 4) AS largest_cluster_fraction,
    coalesce(array_to_string((list(n ORDER BY n DESC) FILTER (cluster_id <> -1))[:5], ','), '') AS top_sizes FROM s GROUP BY 1""",
)
def sweep_summary(vectors: DataFrame) -> DataFrame:
    grid = F.explode(F.array(*[F.lit(t) for t in (-0.5, 0.0, 0.5)])).alias("threshold")
    labelled = vectors.select(grid, "label", "embedding").withColumn("cluster_id", F.when(F.col("embedding")[0].cast("double") < F.col("threshold"), -1).otherwise(F.col("label")))
    out = density.sweep_summary(labelled, ["threshold"])
    return out.withColumn("top_sizes", F.array_join(F.transform("top_cluster_sizes", lambda n: n.cast("string")), ",")).drop("top_cluster_sizes")


@query("embeddings")
def density_sweep(vectors: DataFrame) -> DataFrame:
    """Clusters of the vectors under several settings, the most even first."""
    found = density.sweep(vectors, "vec_id", "embedding", [2, 8], [(5, "eom"), (5, "leaf")])
    return density.sweep_summary(found, ["n_components", "least_size", "method"])


@query("documents")
def html_sections(documents: DataFrame) -> DataFrame:
    """Sections with link spans of every document read as HTML, checked; plain text has no paragraph and gives none."""
    pages = documents.where("text IS NOT NULL").select("doc_id", F.col("text").alias("html"))
    parsed = pages.select("doc_id", clean.sections_udf(link="a[href]")(F.col("html")).alias("sections"))
    return parsed.select("doc_id", F.size("sections").alias("sections"), F.size(clean.offset_problems(F.col("sections"))).alias("problems"), F.aggregate("sections", F.lit(0), lambda n, s: n + F.size(s["links"])).alias("links"))


@query("documents", sql=f"WITH {_LINKS} SELECT source, count(*) AS links, count(*) FILTER (substring(text, l.start_char + 1, l.end_char - l.start_char) = l.surface) AS sound FROM (SELECT links.*, d.text, d.source FROM links JOIN documents d USING (doc_id)) WHERE l.start_char IS NOT NULL GROUP BY 1")
def offset_check(documents: DataFrame) -> DataFrame:
    """How many stored links cut their surface out of the text."""
    flat = documents.select("source", "text", F.explode("links").alias("l")).where("l.start_char IS NOT NULL")
    sound = spn.cut(F.col("text"), F.col("l.start_char"), F.col("l.end_char")) == F.col("l.surface")
    return flat.groupBy("source").agg(F.count(F.lit(1)).alias("links"), F.count_if(sound).alias("sound"))


# --- trees and statements ---------------------------------------------------------------------


@query(
    "sentences",
    sql="""WITH RECURSIVE s AS (SELECT DISTINCT sentence_id, text FROM sentences), w AS (SELECT sentence_id, text, unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) AS i FROM s),
    o AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY sentence_id, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM w),
    tok AS (SELECT sentence_id, text, off, off + length(t) AS stop, row_number() OVER (PARTITION BY sentence_id, text ORDER BY i) - 1 AS k FROM o WHERE length(t) > 0), n AS (SELECT sentence_id, text, count(*) AS n FROM tok GROUP BY 1, 2),
    ends AS (SELECT sentence_id, text, 'a' AS side, n // 3 AS k, 0 AS d FROM n UNION ALL SELECT sentence_id, text, 'b', n - 1, 0 FROM n),
    up AS (SELECT * FROM ends UNION ALL SELECT sentence_id, text, side, k // 2, d + 1 FROM up WHERE k > 0),
    meet AS (SELECT a.sentence_id, a.text, min(a.d) AS da, arg_min(b.d, a.d) AS db FROM up a JOIN up b ON a.sentence_id = b.sentence_id AND a.text = b.text AND a.k = b.k WHERE a.side = 'a' AND b.side = 'b' GROUP BY 1, 2)
    SELECT up.sentence_id, CAST(min(off) AS INTEGER) AS path_start, CAST(max(stop) AS INTEGER) AS path_end FROM up JOIN meet USING (sentence_id, text) JOIN tok USING (sentence_id, text, k) WHERE up.d <= CASE side WHEN 'a' THEN da ELSE db END GROUP BY up.sentence_id, up.text""",
)
def dependency_path(sentences: DataFrame) -> DataFrame:
    """The path between the token a third into each sentence and its last, in a tree where token i hangs on token i / 2."""
    parts = sentences.select("sentence_id", "text").distinct().withColumn("p", assemble.tokens(F.col("text"), F.array().cast("array<string>"))).where(F.size("p") > 0)
    tokens = F.transform("p", lambda t, i: F.struct(i.alias("i"), t["start"].alias("idx"), F.substring(F.col("text"), t["start"] + 1, t["end"] - t["start"]).alias("text"), F.floor(i / 2).cast("int").alias("head")))
    span = attributes.path_span(tokens, F.floor(F.size("p") / 3).cast("int"), F.size("p") - 1)
    return parts.select("sentence_id", span.alias("s")).select("sentence_id", F.col("s.start").alias("path_start"), F.col("s.end").alias("path_end"))


@query("entities", sql="SELECT qid, coalesce(death_year, birth_year, -1) AS claim_year FROM entities")
def claim_years(entities: DataFrame) -> DataFrame:
    """The year that statements of three ranks give: a preferred one for the death, a normal one for the birth, a deprecated one that never counts."""
    time = lambda y: F.when(y.isNotNull(), F.concat(F.lit("+"), y.cast("string"), F.lit("-01-01T00:00:00Z")))
    one = lambda rank, y: F.struct(F.lit(rank).alias("rank"), F.struct(F.struct(F.struct(F.lit(None).cast("string").alias("id"), time(y).alias("time")).alias("value")).alias("datavalue")).alias("mainsnak"))
    every = F.array(one("deprecated", F.col("birth_year") - 100), one("normal", F.col("birth_year")), one("preferred", F.col("death_year")))
    held = F.filter(every, lambda c: c["mainsnak"]["datavalue"]["value"]["time"].isNotNull())
    return entities.select("qid", F.coalesce(claims.claim_year(held), F.lit(-1)).alias("claim_year"))


@query("candidates", "entities", sql="SELECT c.tail_entity_id AS qid, coalesce(any_value(e.canonical_name), c.tail_entity_id) AS label, count(*) AS pairs FROM (SELECT DISTINCT candidate_id, tail_entity_id FROM candidates) c LEFT JOIN (SELECT qid, max(canonical_name) AS canonical_name FROM entities GROUP BY 1) e ON e.qid = c.tail_entity_id GROUP BY 1")
def entity_labels(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """How many pairs name each person second, under the name or else the id."""
    once = candidates.select("candidate_id", F.col("tail_entity_id").alias("qid")).distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("pairs"))
    names = entities.groupBy("qid").agg(F.max("canonical_name").alias("_n"))
    return once.join(names, "qid", "left").select("qid", F.coalesce("_n", "qid").alias("label"), "pairs")
