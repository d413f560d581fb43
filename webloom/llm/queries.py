"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.boilerplate import remove_boilerplate
from webloom.llm.chat import early_rejections, preference_pairs, spans
from webloom.llm.embeddings import embedding_near_dup
from webloom.llm.line_dedup import line_dedup
from webloom.llm.mixing import mixing_rates
from webloom.llm.ngram_join import ngram_jaccard_join
from webloom.llm.packing import best_fit_packing
from webloom.llm.pii import pseudonymise
from webloom.llm.quality import quality_rules
from webloom.llm.sharding import with_shards
from webloom.session import spread

#: A public byte-level vocabulary; a path, so that a cluster can name its own place for it.
VOCABULARY = os.environ.get("WEBLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Shares of tokens, and their sum in units of the input's tokens.
TARGETS, BUDGET = {"clean": 0.96, "low": 0.02, "toxic": 0.02}, 1.25
#: For the registered query only: a deployment passes its own secret.
DEMO_KEY = b"not a secret"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=5, threshold=0.4)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"), max_count=6)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_table(spark, sf_dir, "documents"), VOCABULARY, capacity=4096)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference_pairs(*early_rejections(_table(spark, sf_dir, "conversations")))
    listed = {f"{x}_trained": F.array_join(F.transform(spans(F.col(f"{x}_segments")), lambda s: F.concat_ws("-", s["start"], s["end"])), ",") for x in ("chosen", "rejected")}
    return pairs.withColumns(listed).drop("chosen_segments", "rejected_segments")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(_table(spark, sf_dir, "pages"), min_tokens=16)


def op6_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dup(_table(spark, sf_dir, "embeddings"), threshold=0.9, recall=0.99)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), limit=4_000_000).drop("text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), TARGETS, VOCABULARY, BUDGET)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_table(spark, sf_dir, "documents"), DEMO_KEY)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.where("not rejected").drop("rejected", "failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_line_dedup": op2_line_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_html_extraction": op5_html_extraction,
    "op6_embedding_near_dup": op6_embedding_near_dup,
    "op7_sharding": op7_sharding,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL
        ), g AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS gram
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
        ), s AS (
            SELECT doc_id, count(*) AS size FROM g GROUP BY 1
        ), c AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), p AS (
            SELECT x, y, common = sx.size AND common = sy.size AS same
            FROM c JOIN s sx ON sx.doc_id = x JOIN s sy ON sy.doc_id = y
            WHERE common >= 0.4 * (sx.size + sy.size - common) - 1e-9
        ), e AS (
            SELECT x AS doc_id, y AS other, same FROM p UNION ALL SELECT y, x, same FROM p
        ), r(doc_id, other) AS (
            SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.other FROM r JOIN e ON r.other = e.doc_id
        ), k AS (
            SELECT doc_id, min(other) AS class_id FROM r GROUP BY 1
        ), n AS (
            SELECT doc_id, count(*) AS links, count(*) FILTER (same) AS copies FROM e GROUP BY 1
        )
        SELECT doc_id, class_id, 1 + coalesce(copies, 0) AS copies, coalesce(links, 0) AS links FROM k LEFT JOIN n USING (doc_id)
    """,
    "op2_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL
        ), c AS (
            SELECT trim(line, ' ') AS t, min(doc_id) AS owner FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(*) > 6
        ), m AS (
            SELECT l.doc_id, l.line, l.i, c.owner, row_number() OVER (PARTITION BY l.doc_id, trim(l.line, ' ') ORDER BY l.i) AS nth
            FROM l LEFT JOIN c ON trim(l.line, ' ') = c.t
        ), k AS (
            SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS kept FROM m WHERE owner IS NULL OR (owner = doc_id AND nth = 1) GROUP BY 1
        ), n AS (
            SELECT doc_id, count(*) AS n FROM l GROUP BY 1
        )
        SELECT d.doc_id, CASE WHEN d.text IS NULL OR n.n = k.n THEN d.text ELSE k.kept END AS text, d.lang, d.source,
            CASE WHEN d.text IS NULL OR n.n = k.n THEN d.n_chars ELSE length(k.kept) END AS n_chars,
            CASE WHEN d.text IS NULL THEN 0 ELSE n.n - coalesce(k.n, 0) END::INTEGER AS lines_removed
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
        WHERE d.text IS NULL OR n.n = k.n OR regexp_matches(k.kept, '[^ \n]')
    """,
    "op4_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
        ), p AS (
            SELECT conv_id, role, text, row_number() OVER w AS i, lag(text) OVER w AS prev FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        ), a AS (
            SELECT conv_id, i, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM p WHERE role = 'assistant' AND i > 1
        ), s AS (
            SELECT conv_id, i AS here FROM a WHERE k = 1 + conv_id % n
        ), c AS (
            SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS c FROM p JOIN s USING (conv_id) GROUP BY 1
        ), r AS (
            SELECT conv_id, list({'role': role, 'text': CASE WHEN i = here THEN prev ELSE text END} ORDER BY i) AS r
            FROM p JOIN s USING (conv_id) WHERE NOT (i = here + 1 AND conv_id % 2 = 0) GROUP BY 1
        ), b AS (
            SELECT conv_id, c, r, list_filter(range(1, greatest(len(c), len(r)) + 2), lambda i: i > least(len(c), len(r)) OR c[i] <> r[i])[1] - 1 AS n FROM c JOIN r USING (conv_id)
        ), y AS (
            SELECT conv_id, n, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM b
        )
        SELECT conv_id, n::INTEGER AS prefix_turns,
            list_reduce(list_transform(p, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), lambda x, y: x || y, '') AS prompt,
            list_reduce(list_transform(c, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), lambda x, y: x || y, '') AS chosen,
            list_reduce(list_transform(r, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), lambda x, y: x || y, '') AS rejected,
            array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda j: c[j].role = 'assistant'), lambda j:
                (coalesce(list_sum(list_transform(c[1:j - 1], lambda z: length(z.role) + length(z.text) + 13)), 0)::INTEGER + 14)
                || '-' || (coalesce(list_sum(list_transform(c[1:j], lambda z: length(z.role) + length(z.text) + 13)), 0)::INTEGER)), ',') AS chosen_trained,
            array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda j: r[j].role = 'assistant'), lambda j:
                (coalesce(list_sum(list_transform(r[1:j - 1], lambda z: length(z.role) + length(z.text) + 13)), 0)::INTEGER + 14)
                || '-' || (coalesce(list_sum(list_transform(r[1:j], lambda z: length(z.role) + length(z.text) + 13)), 0)::INTEGER)), ',') AS rejected_trained
        FROM y
        WHERE len(list_filter(list_concat(c, r), lambda x: x.role = 'assistant' AND x.text <> '')) > 0
    """,
    "op6_embedding_near_dup": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS e FROM embeddings
        ), s AS (
            SELECT min(vec_id) AS name, list(vec_id ORDER BY vec_id) AS ids, any_value(e) AS e FROM v GROUP BY list_transform(e, lambda x: round(x, 9))
        ), p AS (
            SELECT a.name AS x, b.name AS y, len(b.ids) AS n FROM s a JOIN s b ON a.name <> b.name WHERE list_inner_product(a.e, b.e) >= 0.9
        ), r(name, other) AS (
            SELECT name, name FROM s UNION SELECT r.name, p.y FROM r JOIN p ON r.other = p.x
        ), k AS (
            SELECT name, min(other) AS class_id FROM r GROUP BY 1
        ), n AS (
            SELECT x AS name, sum(n)::BIGINT AS near FROM p GROUP BY 1
        )
        SELECT unnest(ids) AS vec_id, class_id, len(ids) AS copies, len(ids) - 1 + coalesce(near, 0) AS links FROM s JOIN k USING (name) LEFT JOIN n USING (name)
    """,
    "op7_sharding": r"""
        WITH d AS (
            SELECT doc_id, ('0x' || substring(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0) AS b FROM documents
        ), s AS (
            SELECT depth, h >> (60 - depth) AS p, sum(b)::BIGINT AS bytes, min(h) = max(h) AS one FROM d, range(0, 61) AS r(depth) GROUP BY 1, 2
        ), m AS (
            SELECT d.doc_id, d.h, min(s.depth) AS depth FROM d JOIN s ON s.p = d.h >> (60 - s.depth) WHERE s.bytes <= 4000000 OR s.one GROUP BY 1, 2
        )
        SELECT m.doc_id, substring((m.h::BIT)::VARCHAR, 5, m.depth::INTEGER) AS shard, m.depth::INTEGER AS depth, s.bytes AS shard_bytes, s.bytes <= 4000000 AS fits
        FROM m JOIN s ON s.depth = m.depth AND s.p = m.h >> (60 - m.depth)
    """,
    "op10_quality_rules": r"""
        WITH w AS (
            SELECT *, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
                list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \t\x0B\f\r')), lambda x: x <> '') AS ls
            FROM documents
        ), m AS (
            SELECT doc_id, text, lang, source, n_chars,
                length(regexp_replace(text, '[^\x00-\x08\x0E-\x1F#$%&()*+/<=>@\[\\\]^_`{|}~\x7F]', '', 'g')) / greatest(length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')), 1) AS symbols,
                len(list_filter(ws, lambda x: regexp_full_match(x, '[\x00-\x60\x7B-\x7F]*') AND length(regexp_replace(x, '[^A-Z]', '', 'g')) >= 2)) / greatest(len(ws), 1) AS shouting,
                len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) / greatest(len(ws), 1) AS repetition,
                len(list_filter(ws, lambda x: x = '|')) / greatest(len(ws), 1) AS tables,
                (len(ls) - len(list_distinct(ls))) / greatest(len(ls), 1) AS doubling
            FROM w
        ), good AS (
            SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1
        ), held AS (
            UNPIVOT (SELECT lang, symbols, shouting, repetition, tables, doubling FROM m WHERE text <> '' AND doc_id IN (FROM good))
            ON symbols, shouting, repetition, tables, doubling INTO NAME rule VALUE v
        ), n AS (
            SELECT lang, count(*) // 5 AS n, count(*) OVER () AS strata FROM held GROUP BY 1
        ), terms AS (
            SELECT lang, n, strata, j, exp(lgamma(n + 1) - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END - CASE WHEN j = n THEN 0 ELSE lgamma(n - j + 1) END + j * ln(0.02 / 5) + (n - j) * ln(1 - 0.02 / 5)) AS p
            FROM n, LATERAL (SELECT unnest(range(0, n + 1)) AS j)
        ), rank AS (
            SELECT lang, count(*) FILTER (cdf <= 0.05 / (5 * strata)) AS k FROM (SELECT lang, strata, sum(p) OVER (PARTITION BY lang ORDER BY j) AS cdf FROM terms) GROUP BY 1
        ), ordered AS (
            SELECT lang, rule, v, row_number() OVER (PARTITION BY lang, rule ORDER BY v DESC) AS nth FROM held
        ), cut AS (
            SELECT o.lang, o.rule, o.v AS cutoff FROM ordered o JOIN rank r ON o.lang IS NOT DISTINCT FROM r.lang AND o.nth = r.k
        ), bad AS (
            SELECT DISTINCT m.doc_id FROM (UNPIVOT (SELECT doc_id, lang, symbols, shouting, repetition, tables, doubling FROM m) ON symbols, shouting, repetition, tables, doubling INTO NAME rule VALUE v) m
            JOIN cut c ON c.lang IS NOT DISTINCT FROM m.lang AND c.rule = m.rule WHERE m.v > c.cutoff
        )
        SELECT doc_id, text, lang, source, n_chars FROM documents WHERE text <> '' AND doc_id NOT IN (FROM bad)
    """,
}
