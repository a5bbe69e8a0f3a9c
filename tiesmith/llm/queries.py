"""The queries of this package: pN_... of problem N, and their SQL where SQL can say them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiesmith.llm import canonical, clusters, leakage, markup, packing, pairs, sentences, shared_spans, terms
from tiesmith.session import durable, table

TOKENIZERS = os.environ.get("TIESMITH_TOKENIZERS", "/opt/tokenizers")
SENTENCE = ["doc_id", "section_idx", "sent_idx"]


def _steady(spark: SparkSession) -> None:
    """Texts come in Arrow batches of bounded rows, so that a batch of long ones fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def _over(*names: str):
    def wrap(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            _steady(spark)
            return f(*(table(spark, d, n) for n in names))

        return run

    return wrap


@_over("sentences")
def p1_found(sentences: DataFrame) -> DataFrame:
    found = clusters.similar_pairs(sentences, "sentence_id", "masked_sentence")
    return found.select(F.col("key_a").alias("sentence_id_a"), F.col("key_b").alias("sentence_id_b"))


@_over("sentences")
def p1_clusters(sentences: DataFrame) -> DataFrame:
    members = durable(clusters.cluster_members(sentences, "sentence_id", "masked_sentence"))
    return clusters.cluster_summary(members, sentences, "sentence_id", "masked_sentence").withColumnRenamed("key", "sentence_id")


@_over("candidates", "sentences")
def p1_assign(candidates: DataFrame, sentences: DataFrame) -> DataFrame:
    """Candidates with a fresh cluster_id; null where the sentence has no masked wording."""
    members = clusters.cluster_members(sentences, "sentence_id", "masked_sentence").groupBy("key").agg(F.min("cluster_id").alias("fresh"))
    joined = candidates.drop("cluster_id").join(members, candidates["sentence_id"] == members["key"], "left")
    return joined.select("candidate_id", "sentence_id", F.col("fresh").alias("cluster_id"))


@_over("documents")
def p2_found(documents: DataFrame) -> DataFrame:
    parsed = markup.parse(documents).where("marked")
    whole = F.array(F.struct(F.lit("markup").alias("kind"), F.lit("").alias("content")))
    return parsed.select("doc_id", F.explode(F.concat(whole, "elements")).alias("e")).select("doc_id", "e.kind", "e.content")


@_over("documents")
def p2_clean(documents: DataFrame) -> DataFrame:
    """Every document's clean text with the links that still mark their surfaces."""
    return markup.cleaned(documents)


@_over("mentions")
def p3_found(mentions: DataFrame) -> DataFrame:
    found = pairs.together(mentions, SENTENCE, "entity_id", least=5, least_lift=10.0)
    return found.select(F.col("item_a").alias("entity_id_a"), F.col("item_b").alias("entity_id_b"))


@_over("mentions")
def p3_pairs(mentions: DataFrame) -> DataFrame:
    found = pairs.together(mentions, SENTENCE, "entity_id")
    return found.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 4).alias("lift"), F.round("odds_ratio", 4).alias("odds_ratio"))


def _titles(documents: DataFrame) -> DataFrame:
    return terms.term_frequency(documents.select(F.transform("links", lambda link: link["target_title"]).alias("titles")), "titles")


@_over("documents")
def p4_found(documents: DataFrame) -> DataFrame:
    return _titles(documents).where("mark IS NOT NULL").select(F.col("term").alias("target_title"), "mark")


@_over("documents")
def p4_counts(documents: DataFrame) -> DataFrame:
    return _titles(documents).select(F.col("term").alias("target_title"), "occurrences", "records", F.coalesce("mark", F.lit("")).alias("mark"))


@_over("attribute_spans", "attribute_values")
def p5_found(spans: DataFrame, reference: DataFrame) -> DataFrame:
    return canonical.map_spans(spans, reference).select("span_id", "ref_id")


@_over("attribute_spans", "attribute_values")
def p5_unmatched(spans: DataFrame, reference: DataFrame) -> DataFrame:
    """Values without an entry, by how many spans hold them."""
    missed = canonical.map_spans(spans, reference).where("ref_id = -1")
    return missed.groupBy("attr_type", "value").agg(F.count(F.lit(1)).alias("spans"))


@_over("documents")
def p6_found(documents: DataFrame) -> DataFrame:
    archive = documents.where("source = 'archive'").select("doc_id", "text").distinct()
    return sentences.sentences(archive).select("doc_id", "start_char", "end_char")


@_over("documents")
def p6_sentences(documents: DataFrame) -> DataFrame:
    """Sentences and their mean length in every document, whatever its source."""
    found = sentences.sentences(documents)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.round(F.avg(F.length("sentence")), 2).alias("mean_chars"))


@_over("documents")
def p7_containers(documents: DataFrame) -> DataFrame:
    import public_tokenizers

    sized = durable(packing.measure(documents, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", public_tokenizers.PATTERN))
    return packing.pack(sized).withColumnRenamed("item", "doc_id")


@_over("documents")
def p7_filling(documents: DataFrame) -> DataFrame:
    """How full the containers are, beside the least number that could hold all tokens."""
    import public_tokenizers

    sized = durable(packing.measure(documents, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", public_tokenizers.PATTERN))
    return packing.filling(packing.pack(sized))


@_over("documents", "eval_items")
def p8_found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leakage.leaks(documents, items).select("doc_id", "item_id")


@_over("documents", "eval_items")
def p8_passages(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Passages that reach the limit of coverage or of the longest verbatim run."""
    return leakage.leaks(documents, items, most_longest=12)


@_over("documents", "eval_items")
def p8_clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Every document's text without the passages of test items."""
    return leakage.decontaminate(documents, items).select("doc_id", "clean_text")


@_over("documents")
def p9_found(documents: DataFrame) -> DataFrame:
    return shared_spans.shared_pairs(documents)


@_over("documents")
def p9_shares(documents: DataFrame) -> DataFrame:
    return shared_spans.shared_share(documents)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


_NAMED = """
named AS (SELECT DISTINCT doc_id, section_idx, sent_idx, entity_id AS e FROM mentions
  WHERE doc_id IS NOT NULL AND section_idx IS NOT NULL AND sent_idx IS NOT NULL AND entity_id IS NOT NULL),
total AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, section_idx, sent_idx FROM named)),
single AS (SELECT e, count(*) AS n FROM named GROUP BY e),
met AS (SELECT a.e AS a, b.e AS b, count(*) AS n FROM named a JOIN named b
  ON a.doc_id = b.doc_id AND a.section_idx = b.section_idx AND a.sent_idx = b.sent_idx AND a.e < b.e GROUP BY 1, 2)
"""

_GRAMS = """
held AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
grams AS (SELECT doc_id, p, hash(substr(text, p, 200)) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS p FROM held WHERE length(text) >= 200)),
several AS (SELECT g FROM grams GROUP BY g HAVING min(doc_id) < max(doc_id)),
places AS (SELECT doc_id, p, g FROM grams WHERE g IN (SELECT g FROM several))
"""

_WORDS = r"""
word AS (SELECT DISTINCT sentence_id, unnest(regexp_extract_all(lower(strip_accents(wording)), '[\p{L}\p{N}]+')) AS w
  FROM (SELECT sentence_id, min(masked_sentence) AS wording FROM sentences WHERE masked_sentence IS NOT NULL AND sentence_id IS NOT NULL GROUP BY 1)),
size AS (SELECT sentence_id, count(*) AS n, list(w ORDER BY w) AS ws FROM word GROUP BY 1),
kind AS (SELECT ws, n, row_number() OVER () AS k FROM (SELECT DISTINCT ws, n FROM size)),
each AS (SELECT k, n, unnest(ws) AS w FROM kind),
met AS (SELECT a.k AS a, b.k AS b FROM each a JOIN each b ON a.w = b.w AND a.k < b.k AND 5 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY a.k, b.k, a.n, b.n HAVING count(*) * 8 >= 3 * (a.n + b.n)),
near AS (SELECT a, b FROM met UNION ALL SELECT b, a FROM met UNION ALL SELECT k, k FROM kind),
member AS (SELECT sentence_id, k FROM size JOIN kind USING (ws))
"""

_TITLES = r"""
raw AS (SELECT doc_id, unnest(links).target_title AS t FROM documents),
plain AS (SELECT doc_id, replace(replace(replace(replace(t, '&#x27;', ''''), '&#39;', ''''), '&quot;', '"'), '&amp;', '&') AS t FROM raw WHERE t IS NOT NULL),
bare AS (SELECT doc_id, replace(url_decode(replace(split_part(split_part(t, '#', 1), '?', 1), '+', '%2B')), '_', ' ') AS t FROM plain),
tidy AS (SELECT doc_id, nfc_normalize(trim(regexp_replace(t, '[\s\x{00A0}]+', ' ', 'g'))) AS t FROM bare),
title AS (SELECT doc_id, upper(t[1]) || t[2:] AS target_title FROM tidy WHERE t <> ''),
counted AS (SELECT target_title, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM title GROUP BY 1),
marked AS (SELECT *, CASE WHEN records < 2 THEN 'rare' WHEN records > 0.05 * (SELECT count(*) FROM documents) THEN 'common' ELSE '' END AS mark FROM counted)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_WORDS} SELECT x.sentence_id AS sentence_id_a, y.sentence_id AS sentence_id_b FROM near JOIN member x ON x.k = a JOIN member y ON y.k = b WHERE x.sentence_id < y.sentence_id",
        "p9_found": f"WITH {_GRAMS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM places a JOIN places b ON a.g = b.g AND a.doc_id < b.doc_id",
        "p9_shares": f"WITH {_GRAMS}, fresh AS (SELECT doc_id, least(200, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), p - 200)) AS n FROM (SELECT DISTINCT doc_id, p FROM places)), shared AS (SELECT doc_id, sum(n)::BIGINT AS n FROM fresh GROUP BY doc_id) SELECT held.doc_id, length(text)::BIGINT AS n_chars, coalesce(n, 0)::BIGINT AS shared_chars, CASE WHEN length(text) > 0 THEN round(coalesce(n, 0) / length(text), 6) ELSE 0 END AS shared_ratio FROM held LEFT JOIN shared USING (doc_id)",
        "p3_found": f"WITH {_NAMED} SELECT a AS entity_id_a, b AS entity_id_b FROM met JOIN single x ON x.e = a JOIN single y ON y.e = b, total WHERE met.n >= 5 AND met.n * total.n >= 10 * x.n * y.n",
        "p3_pairs": f"WITH {_NAMED} SELECT a AS item_a, b AS item_b, met.n AS n_ab, x.n AS n_a, y.n AS n_b, total.n AS n, round(met.n * total.n / (x.n * y.n), 4) AS lift, round(((met.n + 0.5::DOUBLE) * (total.n - x.n - y.n + met.n + 0.5::DOUBLE)) / ((x.n - met.n + 0.5::DOUBLE) * (y.n - met.n + 0.5::DOUBLE)), 4) AS odds_ratio FROM met JOIN single x ON x.e = a JOIN single y ON y.e = b, total",
        "p4_found": f"WITH {_TITLES} SELECT target_title, mark FROM marked WHERE mark <> ''",
        "p4_counts": f"WITH {_TITLES} SELECT target_title, occurrences, records, mark FROM marked",
    }
