"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.llm.backoff import corpus_scores
from galena.llm.chat import CONTROL, round_trip
from galena.llm.exact_dedup import exact_groups
from galena.llm.bpe import encode_documents, read_ranks
from galena.llm.decontaminate import contamination
from galena.llm.filter_audit import interactions
from galena.llm.fingerprints import edited_fingerprints
from galena.llm.hard_negatives import hard_negatives
from galena.llm.near_dedup import near_classes
from galena.llm.quality import judge
from galena.llm.scratch import Scratch
from galena.llm.suffixes import repeated_passages
from galena.llm.warc import page_archives, read_pages
from galena.llm.token_files import read_token_files, write_token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-files").root
    write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return read_token_files(spark, path, with_ids=False)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return round_trip(rows.unionByName(spark.createDataFrame(own, "conv_id long, turn long, role string, text string")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_table(spark, sf_dir, "documents"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_scores(_table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("repeated", lambda s: F.concat(s.start.cast("string"), F.lit("-"), s.end.cast("string"))), ",")
    return repeated_passages(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_repeated", spans.alias("spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode_documents(_table(spark, sf_dir, "documents"), tokens, public_tokenizers.PATTERN).drop("ids")


def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    scratch.keep("archives", page_archives(_table(spark, sf_dir, "pages")))
    return read_pages(spark, scratch.path("archives"), scratch)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_files": op2_token_files,
    "op3_chat_format": op3_chat_format,
    "op4_lm_scores": op4_lm_scores,
    "op5_quality": op5_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_near_dedup": op9_near_dedup,
    "op10_arc_to_warc": op10_arc_to_warc,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_fingerprints": op12_fingerprints,
    "op13_filter_audit": op13_filter_audit,
}

#: Characters that escaping adds to column {0}: one for each control string and for each backslash.
_ADDED = " + ".join(f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in (*CONTROL, "\\"))

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        b AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        iw AS (
            SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
            FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
        dw AS (
            SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
            FROM d, (SELECT DISTINCT n FROM iw), unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)),
        hit AS (SELECT doc_id, item, i, n FROM dw JOIN iw USING (n, gram)),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op3_chat_format": rf"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        g AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                   coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
                   CAST(sum(24 + length(role) + length(text) + {_ADDED.format("text")} + {_ADDED.format("role")}) AS BIGINT) AS formatted_chars
            FROM c GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
    "op4_lm_scores": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        t AS (
            SELECT doc_id, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS g2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3
            FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
        g AS (SELECT doc_id, g1 AS g FROM t UNION ALL SELECT doc_id, g2 FROM t WHERE g2 IS NOT NULL UNION ALL SELECT doc_id, g3 FROM t WHERE g3 IS NOT NULL),
        own AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL),
        rest AS (SELECT doc_id, g, sum(n) OVER (PARTITION BY g) - n AS n FROM own),
        x AS (
            SELECT t.doc_id, t.i, r1.n AS n1, r2.n AS n2, r3.n AS n3, lag(r1.n) OVER w AS c1, lag(r2.n) OVER w AS c2
            FROM t JOIN rest r1 ON r1.doc_id = t.doc_id AND r1.g = t.g1
            LEFT JOIN rest r2 ON r2.doc_id = t.doc_id AND r2.g = t.g2 LEFT JOIN rest r3 ON r3.doc_id = t.doc_id AND r3.g = t.g3
            WINDOW w AS (PARTITION BY t.doc_id ORDER BY t.i)),
        z AS (SELECT doc_id, greatest((SELECT count(*) FROM t) - len(w), 1) AS n_all FROM d),
        s AS (
            SELECT x.doc_id, avg(CASE WHEN n3 > 0 THEN ln(n3 / c2)
                WHEN n2 > 0 THEN ln(n2 / c1) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
                ELSE ln(CASE WHEN n1 > 0 THEN n1 ELSE 0.5 END / n_all) + least(i - 1, 2) * ln(0.4) END) AS score
            FROM x JOIN z USING (doc_id) GROUP BY x.doc_id)
        SELECT doc_id, len(w) AS n_words, round(score, 6) AS score FROM d LEFT JOIN s USING (doc_id)""",
    "op6_suffix_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p AS (SELECT doc_id, i, hash(w[i + 1:i + 50]) AS h FROM d, unnest(range(0, greatest(len(w) - 49, 0))) AS u(i)),
        r AS (SELECT h FROM p GROUP BY h HAVING count(DISTINCT doc_id) > 1),
        o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM p JOIN r USING (h)),
        n AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o),
        s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY doc_id, k),
        z AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_repeated, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM s GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_repeated, 0) AS n_repeated, coalesce(spans, '') AS spans FROM d LEFT JOIN z USING (doc_id)""",
    "op9_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        s AS (
            SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS gram, count(*) AS n
            FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0 GROUP BY ALL),
        z AS (SELECT doc_id, sum(n) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM o JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE common >= 0.8 * (za.n + zb.n - common)),
        r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept
        FROM (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a)""",
    "op7_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS raw_len,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER w = 1 AS kept,
               sha256(norm) AS text_sha256,
               CAST(raw_len AS INTEGER) AS raw_len
        FROM n
        WINDOW w AS (PARTITION BY norm ORDER BY raw_len DESC, doc_id NULLS LAST)""",
    "op10_arc_to_warc": r"""
        WITH p AS (
            SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n,
                   min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
            FROM pages)
        SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
               url AS target_uri
        FROM p""",
    "op11_hard_negatives": r"""
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
            FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 5""",
    "op12_fingerprints": r"""
        WITH d AS (
            SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS after
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (ORDER BY doc_id)),
        e AS (SELECT *, left(t, n - n // 4) || left(after, n // 4) AS edited FROM d),
        x AS (SELECT doc_id, 'own' AS kind, t AS text FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e UNION ALL SELECT doc_id, 'after', after FROM e),
        w AS (SELECT doc_id, kind, regexp_extract_all(lower(replace(text, 'Σ', 'σ')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
        s AS (
            SELECT doc_id, kind, CASE WHEN len(w) = 0 THEN [] ELSE
                list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: left(md5(array_to_string(w[i:i + 4], ' ')), 16))))[1:128] END AS s FROM w),
        p AS (SELECT e.doc_id, n, edited, a.s AS a, b.s AS b, c.s AS c FROM e JOIN s a ON a.doc_id = e.doc_id AND a.kind = 'own' JOIN s b ON b.doc_id = e.doc_id AND b.kind = 'edited' JOIN s c ON c.doc_id = e.doc_id AND c.kind = 'after'),
        u AS (SELECT *, list_sort(list_distinct(list_concat(a, b)))[1:128] AS ab, list_sort(list_distinct(list_concat(a, c)))[1:128] AS ac FROM p),
        v AS (SELECT *, len(list_intersect(list_intersect(a, b), ab)) AS n_ab, len(list_intersect(list_intersect(a, c), ac)) AS n_ac, len(list_intersect(a, ab)) AS own FROM u)
        SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
               CASE WHEN len(ab) = 0 THEN 1.0 ELSE n_ab / len(ab) END AS near_edited, CASE WHEN len(ac) = 0 THEN 1.0 ELSE n_ac / len(ac) END AS near_next,
               CASE WHEN len(a) = 0 THEN 1.0 ELSE n_ab / nullif(own, 0) END AS contained_edited
        FROM v""",
    "op13_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        y AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
        f AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
                   (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
                   || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
                   || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
            FROM d LEFT JOIN y USING (doc_id)),
        m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY part, fails),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (
            SELECT a.x || b.x || c.x || g.x || h.x AS filter_order FROM l a, l b, l c, l g, l h
            WHERE len(list_distinct([a.x, b.x, c.x, g.x, h.x])) = 5),
        z AS (SELECT filter_order, CAST(i AS INTEGER) AS step, substr(filter_order, i, 1) AS filter, substr(filter_order, 1, i - 1) AS before FROM o, unnest(range(1, 6)) AS u(i)),
        r AS (
            SELECT part, filter_order, step, filter,
                   CAST(coalesce(sum(n) FILTER (WHERE translate(fails, before || filter, '') = fails), 0) AS BIGINT) AS kept,
                   CAST(coalesce(sum(n) FILTER (WHERE contains(fails, filter) AND translate(fails, before, '') = fails), 0) AS BIGINT) AS removed,
                   CAST(coalesce(sum(n) FILTER (WHERE contains(fails, filter) AND translate(fails, before, '') <> fails), 0) AS BIGINT) AS redundant,
                   CAST(coalesce(sum(n) FILTER (WHERE fails = filter), 0) AS BIGINT) AS unique_fails,
                   CAST(coalesce(sum(good) FILTER (WHERE contains(fails, filter) AND translate(fails, before, '') = fails), 0) AS BIGINT) AS good_lost,
                   CAST(coalesce(sum(bad) FILTER (WHERE contains(fails, filter) AND translate(fails, before, '') = fails), 0) AS BIGINT) AS toxic_lost
            FROM m, z GROUP BY ALL)
        SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r""",
}
