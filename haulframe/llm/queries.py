"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulframe.llm.common import documents
from haulframe.llm.exact_dedup import exact_dedup
from haulframe.llm.hard_negatives import hard_negatives
from haulframe.llm.kd_shards import shard
from haulframe.llm.language_id import identify
from haulframe.llm.lm_scoring import score_documents
from haulframe.llm.mixing import mix_report
from haulframe.llm.packing import pack
from haulframe.llm.phrases import collocations
from haulframe.llm.quality_forest import quality
from haulframe.llm.simhash import near_groups
from haulframe.llm.token_counts import token_counts
from haulframe.llm.token_files import token_file_report
from haulframe.llm.url_filter import judge_urls


def op1_url_filter(spark, sf_dir):
    return judge_urls(documents(spark, sf_dir, "pages"))


def op2_quality_rules(spark, sf_dir):
    return quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op3_language_id(spark, sf_dir):
    return identify(documents(spark, sf_dir))


def op4_simhash_near_dedup(spark, sf_dir):
    return near_groups(documents(spark, sf_dir), shingle=3, radius=2)


def op5_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir), limit=1024)


def op6_mixing(spark, sf_dir):
    return mix_report(documents(spark, sf_dir))


def op7_lm_scoring(spark, sf_dir):
    return score_documents(documents(spark, sf_dir))


def op8_sharding(spark, sf_dir):
    return shard(documents(spark, sf_dir), shards=24)


def op9_best_fit_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir), capacity=2048)


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


def op11_phrase_collocations(spark, sf_dir):
    return collocations(documents(spark, sf_dir), threshold=100, top=2000)


def op12_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(documents(spark, sf_dir, "embeddings"), label=label)


def op13_token_files(spark, sf_dir):
    return token_file_report(documents(spark, sf_dir))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_sharding": op8_sharding,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_files": op13_token_files,
}

SQL = {
    "op10_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
            FROM documents),
        g AS (
            SELECT doc_id, sha, count(*) OVER (PARTITION BY sha) AS group_size,
                   first(doc_id) OVER (PARTITION BY sha ORDER BY points DESC, doc_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id
            FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256
        FROM g""",
    "op11_phrase_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        words AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'),
                                     lambda x: x <> '') AS w
            FROM pieces),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
        places AS (
            SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
            FROM words, (SELECT unnest(range(1, 6)) AS k)
            WHERE len(w) >= k),
        counts AS (
            SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase,
                   count(*) AS a
            FROM places GROUP BY ALL HAVING count(*) >= 100),
        cand AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2),
        inner_of AS (
            SELECT lang, a, w, size, unnest(range(1, k - size + 2)) AS i
            FROM cand, (SELECT unnest(range(2, 5)) AS size) WHERE size < k),
        longer AS (
            SELECT lang, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase,
                   max(a) AS longer
            FROM inner_of GROUP BY ALL),
        kept AS (
            SELECT c.* FROM cand c LEFT JOIN longer g USING (lang, phrase)
            WHERE g.longer IS NULL OR g.longer < c.a),
        cuts AS (
            SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS cut FROM kept),
        scored AS (
            SELECT c.lang, c.phrase, c.a, p.a AS l, q.a AS r, t.n, cut,
                   ((1000::HUGEINT * c.a * t.n) // (p.a::HUGEINT * q.a))::BIGINT AS score
            FROM cuts c JOIN totals t ON t.lang = c.lang
            JOIN counts p ON p.lang = c.lang
                AND p.phrase = array_to_string(list_slice(c.w, 1, cut), ' ')
            JOIN counts q ON q.lang = c.lang
                AND q.phrase = array_to_string(list_slice(c.w, cut + 1, c.k), ' ')),
        lowest AS (
            SELECT * FROM scored
            QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang
                   ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM lowest QUALIFY rank <= 2000""",
    "op12_hard_negatives": """
        WITH kept AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                   list_inner_product(a.v, b.v)::BIGINT AS score
            FROM kept a, kept b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        positives AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, positive_id, row_number() OVER (
                   PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same
            AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY rank <= 5""",
}
