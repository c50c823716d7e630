"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .filter_audit import audit_filters
from .html_extract import extract_pages
from .mixing import mix_report
from .near_dedup import near_groups
from .packing import pack
from .pitman_yor import score_documents
from .prefix_trie import prefix_trie
from .quality import fit, score_quality
from .suffix_dedup import cut_repeats
from .surrogates import replace_entities
from .url_filter import judge_urls
from .winnowing import compare_edits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents")).drop("spans", "kept")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("_row")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).drop("_row", "label")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, *fit(docs, table(spark, sf_dir, "labels")))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("tidewatch.surrogate.key", "key of the registered query")
    made = replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    return made.select("doc_id", "text", "n_entities", F.array_join(F.transform("entities", lambda e: e["kind"]), ",").alias("kinds"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_fingerprints, op3_exact_dedup, op4_near_dedup, op5_lm_scores, op6_packing, op7_url_filter, op8_mixing, op9_quality_classifier, op10_pii_surrogates, op11_filter_audit, op12_prefix_trie, op13_html_extract)}

ORACLES = {
    "op3_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
             r AS (SELECT doc_id, body, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) AS place,
                          first_value(doc_id) OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) AS keep_id,
                          count(*) OVER (PARTITION BY body) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM r""",
    "op7_url_filter": r"""
        WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
             r AS (SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
                                  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
                                  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
                                  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
                                  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule,
                          list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' ELSE s END) AS forms FROM u),
             b AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said FROM r),
             seen AS (SELECT host, '/' || coalesce(array_to_string(forms[:i - 1], '/'), '') AS prefix, forms[i] AS segment, count(*) AS n
                      FROM (SELECT host, forms, unnest(generate_series(1, len(forms))) AS i FROM b) GROUP BY ALL),
             wild AS (SELECT host, list(prefix) AS wild FROM (SELECT host, prefix, count(*) AS kinds, sum(n) AS n FROM seen GROUP BY ALL)
                      WHERE kinds >= 10 AND kinds > 0.5 * n GROUP BY host),
             p AS (SELECT b.*, list_transform(forms, lambda s, i: CASE WHEN list_contains(coalesce(wild, []), '/' || coalesce(array_to_string(forms[:i - 1], '/'), '')) THEN '*' ELSE s END) AS parts
                   FROM b LEFT JOIN wild USING (host)),
             s AS (SELECT *, '/' || coalesce(array_to_string(parts, '/'), '') AS template, '/' || coalesce(array_to_string(parts[:len(parts) - 1], '/'), '') AS parent FROM p),
             branch AS (SELECT host, parent, template, count(said) AS n, count(*) FILTER (said = 'block') AS b FROM s GROUP BY ALL),
             total AS (SELECT coalesce(sum(b) / nullif(sum(n), 0), 0.0) AS rate FROM branch),
             j AS (SELECT *, sum(n) OVER (PARTITION BY template) AS tn, sum(b) OVER (PARTITION BY template) AS tb,
                          sum(n) OVER (PARTITION BY host, parent) AS sn, sum(b) OVER (PARTITION BY host, parent) AS sb FROM branch, total),
             o AS (SELECT *, (tb + 4 * rate) / (tn + 4) AS prior,
                          n > 0 AND sn > 0 AND pow(b - n * (sb / nullif(sn, 0)), 2) >= 1.96 * 1.96 * n * (sb / nullif(sn, 0)) * (1 - sb / nullif(sn, 0)) AS own FROM j),
             q AS (SELECT host, parent, template, round((CASE WHEN own THEN b ELSE sb END + 4 * prior) / (CASE WHEN own THEN n ELSE sn END + 4), 9) AS purity FROM o)
        SELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, purity
        FROM s JOIN q USING (host, parent, template)""",
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
             w AS (SELECT *, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY body) AS first FROM d),
             m AS (SELECT doc_id, part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body),
                          regexp_matches(body, '[#$%&*|]'), coalesce(first < doc_id, false)] AS fails FROM w),
             l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
             c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
             f AS (SELECT unnest(generate_series(1, 5)) AS i),
             o AS (SELECT [a.i, b.i, x.i, y.i, z.i] AS p FROM f a, f b, f x, f y, f z WHERE len(list_distinct([a.i, b.i, x.i, y.i, z.i])) = 5),
             s AS (SELECT part, p, step, p[step] AS filter, n, good, toxic, fails[p[step]] AS hit, len(list_filter(fails, lambda t: t)) = 1 AS single,
                          coalesce(list_position(list_transform(p, lambda i: fails[i]), true), 6) AS gone FROM c, o, (SELECT unnest(generate_series(1, 5)) AS step)),
             r AS (SELECT part, p, step, filter, sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed, sum(n) FILTER (hit AND gone < step) AS redundant,
                          sum(n) FILTER (hit AND single) AS unique_fails, sum(good) FILTER (gone = step) AS good_lost, sum(toxic) FILTER (gone = step) AS toxic_lost FROM s GROUP BY ALL)
        SELECT part, array_to_string(list_transform(p, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
               coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
               coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley FROM r""",
    "op12_prefix_trie": r"""
        WITH byte AS (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS x FROM (SELECT unnest(generate_series(0, 255))::BIGINT AS i)),
             crcs AS (SELECT list(x ORDER BY i) AS t FROM byte),
             t AS (SELECT conv_id, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS key, strlen(coalesce(text, ''))::BIGINT AS bytes,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
                   FROM conversations WHERE conv_id IS NOT NULL),
             n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
             h AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base,
                          xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, crcs.t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h FROM n, crcs),
             c AS (SELECT h.*, least(h.h, coalesce(b.n, 0)) AS taken FROM h LEFT JOIN n b ON b.conv_id = h.base),
             r AS (SELECT c.conv_id, t.place AS depth, key, bytes FROM c JOIN t ON t.conv_id = c.base WHERE t.place <= c.h
                   UNION ALL SELECT c.conv_id, taken + t.place - c.h, key, bytes FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.place > c.h),
             p AS (SELECT conv_id, depth, bytes, list(key) OVER (PARTITION BY conv_id ORDER BY depth) AS path, max(depth) OVER (PARTITION BY conv_id) AS len FROM r),
             a AS (SELECT conv_id, depth, bytes, path, len FROM p UNION ALL SELECT conv_id, 0, 0, [], coalesce((SELECT max(depth) FROM r WHERE r.conv_id = c.conv_id), 0) FROM c),
             g AS (SELECT path, depth, min(conv_id) AS m, count(*) AS n_convs, max(bytes) AS bytes, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth) AS ends FROM a GROUP BY path, depth),
             k AS (SELECT g.*, u.m AS pm FROM g LEFT JOIN g u ON u.depth = g.depth - 1 AND u.path = g.path[:g.depth - 1]),
             q AS (SELECT k.*, coalesce(x.n, 0) AS n_children FROM k LEFT JOIN (SELECT pm, depth - 1 AS depth, count(*) AS n FROM k WHERE depth > 0 GROUP BY ALL) x ON x.pm = k.m AND x.depth = k.depth),
             e AS (SELECT n_children = 0 AS leaf, (n_convs - 1) * bytes AS saved, unnest(list_transform(generate_series(0, depth), lambda i: path[:i])) AS path FROM q),
             s AS (SELECT path, sum(leaf::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM e GROUP BY path)
        SELECT m AS conv_id, depth, pm AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM q JOIN s USING (path)""",
}
