"""The registered queries of this subpackage, and their checks in SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeseed.llm import (
    conversations,
    decontaminate,
    divergence,
    jaccard,
    language,
    mixing,
    outliers,
    packing,
    privacy,
    quality,
    repeats,
    secrets,
    urls,
)
from lakeseed.session import configure


def prepared(spark: SparkSession) -> SparkSession:
    """The session with its settings; whole texts are long rows, so Python tasks get them in small batches."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.judged(_table(spark, folder, "documents"))


def op2_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.grouped(_table(spark, folder, "documents"))


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.found(_table(spark, folder, "documents"))


def op4_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.measured(_table(spark, folder, "documents"))


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identified(_table(spark, folder, "documents"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(_table(spark, folder, "documents"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classified(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(_table(spark, folder, "pages"))


def op9_privacy(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.judged(_table(spark, folder, "documents"))


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.judged(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.nodes(_table(spark, folder, "conversations"))


def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audited(_table(spark, folder, "documents"))


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_table(spark, folder, "documents"))


QUERIES = {
    "op1_outliers": op1_outliers,
    "op2_jaccard": op2_jaccard,
    "op3_secrets": op3_secrets,
    "op4_repeats": op4_repeats,
    "op5_language": op5_language,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_urls": op8_urls,
    "op9_privacy": op9_privacy,
    "op10_decontaminate": op10_decontaminate,
    "op11_conversations": op11_conversations,
    "op12_divergence": op12_divergence,
    "op13_packing": op13_packing,
}

CHECKS = {
    "op8_urls": r"""
        WITH RECURSIVE page AS (
            SELECT DISTINCT url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
            FROM pages),
        place AS (
            SELECT url, html, split_part(url, '://', 1) AS scheme, regexp_extract(rest, '^[^/?#]*') AS h,
                   regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS p
            FROM page WHERE rest IS NOT NULL),
        tags AS (
            SELECT url, scheme, h, regexp_replace(p, '[^/]*$', '') AS folder,
                   unnest(regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta)\b[^>]*>')) AS tag
            FROM place WHERE h <> ''),
        links AS (
            SELECT *, regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS link FROM tags
            WHERE regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b')
            UNION ALL
            SELECT *, regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) AS link FROM tags
            WHERE regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')),
        ties AS (
            SELECT url AS source, CASE
                WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
                WHEN starts_with(link, '//') THEN scheme || ':' || link
                WHEN starts_with(link, '/') THEN scheme || '://' || h || link
                ELSE scheme || '://' || h || CASE folder WHEN '' THEN '/' ELSE folder END || link END AS target
            FROM links WHERE link <> ''),
        rests AS (
            SELECT url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
            FROM (SELECT url FROM pages UNION SELECT target FROM ties)),
        split AS (
            SELECT url, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path,
                   regexp_replace(regexp_replace(coalesce(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), ''),
                       '(^|&)(utm_[^&=]*|gclid|fbclid)(=[^&]*)?', '', 'g'), '^&+', '') AS query
            FROM rests),
        rules(verdict, h, p) AS (
            VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                   ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        fits AS (
            SELECT s.url, arg_max({'rule': r.h || r.p, 'verdict': r.verdict}, 2 * length(r.h || r.p) + (r.verdict = 'allow')::INT) AS own
            FROM split s JOIN rules r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p)
            GROUP BY s.url),
        told AS (
            SELECT split.url, host, path, own.rule AS rule, own.verdict AS verdict,
                   CASE WHEN host <> '' THEN host || path || CASE query WHEN '' THEN '' ELSE '?' || query END END AS node
            FROM split LEFT JOIN fits USING (url)),
        edges AS (
            SELECT a.node AS a, b.node AS b FROM ties JOIN told a ON a.url = source JOIN told b ON b.url = target
            WHERE a.node IS NOT NULL AND b.node IS NOT NULL),
        both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
        reach AS (
            SELECT a AS node, a AS root FROM both_ways
            UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node),
        component AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
        flags AS (
            SELECT component, bool_or(coalesce(verdict = 'block', false)) AND NOT bool_or(coalesce(verdict = 'allow', false)) AS blocked
            FROM component JOIN told USING (node)
            WHERE url IN (SELECT source FROM ties UNION SELECT target FROM ties) GROUP BY component)
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
        FROM pages LEFT JOIN told ON told.url IS NOT DISTINCT FROM pages.url
        LEFT JOIN component USING (node) LEFT JOIN flags USING (component)
    """,
    "op10_decontaminate": r"""
        WITH texts AS (
            SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM documents),
        items AS (
            SELECT item_id, ws, least(13, len(ws)) AS k FROM (
                SELECT item_id, regexp_extract_all(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
                FROM benchmark) WHERE len(ws) > 0),
        item_starts AS (SELECT *, unnest(range(1, len(ws) - k + 2)) AS p FROM items),
        windows AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS words FROM item_starts),
        starts AS (
            SELECT row_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p
            FROM texts, (SELECT DISTINCT k FROM windows) WHERE len(ws) >= k),
        found AS (
            SELECT s.row_id, s.p, s.k, w.item_id
            FROM (SELECT row_id, k, p, array_to_string(ws[p:p + k - 1], ' ') AS words FROM starts) s
            JOIN windows w ON w.k = s.k AND w.words = s.words),
        hit AS (
            SELECT row_id, count(DISTINCT place) AS n_hit
            FROM (SELECT row_id, unnest(range(p, p + k)) AS place FROM found) GROUP BY row_id),
        named AS (
            SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL)
            GROUP BY row_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM texts LEFT JOIN hit USING (row_id) LEFT JOIN named USING (row_id)
    """,
    "op11_conversations": r"""
        WITH own AS (
            SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place
            FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (
            SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
                list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                    lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384::BIGINT))) % 4 AS head
            FROM (SELECT DISTINCT conv_id FROM own)),
        rebuilt AS (
            SELECT c.conv_id, 0 AS part, place, said FROM convs c JOIN own o ON o.conv_id = c.base AND place <= head
            UNION ALL
            SELECT c.conv_id, 1, place, said FROM convs c JOIN own o ON o.conv_id = c.conv_id AND place > head),
        whole AS (
            SELECT conv_id, coalesce(list(said ORDER BY part, place) FILTER (said IS NOT NULL), []) AS turns
            FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id),
        members AS (
            SELECT conv_id, depth, turns[1:depth] AS path, len(turns) = depth AS over
            FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS depth FROM whole)),
        nodes AS (
            SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n,
                   string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (over) AS ids
            FROM members GROUP BY path, depth),
        kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        told AS (
            SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE
                   (n - 1) * len(regexp_extract_all(path[-1].text, '[^\x20\x09-\x0D]+')) END AS saved
            FROM nodes LEFT JOIN kids USING (path)),
        sums AS (
            SELECT path[1:above] AS path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
            FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM told) GROUP BY 1)
        SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n AS n_convs, t.n_children, n_leaves,
               saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(t.ids, '')) AS ends_sha256
        FROM told t JOIN sums USING (path) LEFT JOIN nodes p ON t.depth > 0 AND p.path = t.path[1:t.depth - 1]
    """,
    "op12_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   unnest(list_append(regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), NULL)) AS term
            FROM documents),
        kept AS (
            SELECT lang, term, count(*)::HUGEINT AS n FROM docs WHERE term IS NOT NULL
            GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30),
        langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        held AS (SELECT lang, source, term, count(*) AS n FROM docs JOIN kept USING (lang, term) GROUP BY ALL),
        totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM held GROUP BY ALL),
        shares AS (
            SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
                   1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p,
                   1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
            FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang)
            LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
            LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
        sums AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
        WHERE part = 'pair' OR rank <= 50
    """,
}
