"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.llm import language, pii, quality, secret_scan
from quoteflow.llm.common import table
from quoteflow.llm.decontaminate import contained_items
from quoteflow.llm.embedding_dedup import near_duplicates
from quoteflow.llm.ngram_join import jaccard_classes
from quoteflow.llm.packing import read_matrices, write_matrices
from quoteflow.llm.pieces import digests, piece_ids
from quoteflow.llm.prefix_trie import conversation_trie
from quoteflow.llm.ranked_search import ranked
from quoteflow.llm.token_counts import token_counts
from quoteflow.llm.url_filters import judged, rule_table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at Jaccard 0.9 on 3-word shingles: set size and component of each."""
    return jaccard_classes(table(spark, sf_dir, "documents"), n=3, num=9, den=10)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict: its longest rule's, else a block of one of its aliases, else allow."""
    return judged(table(spark, sf_dir, "pages"), rule_table(spark))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item of which a document has 0.8 or more of the 5-word shingles."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: counts, digest of the patterns' spans, all spans."""
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label linked at cosine 0.98: links and component of each."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being junk, and whether it is kept."""
    return quality.scored(table(spark, sf_dir, "documents"))


def op7_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts' ids as packed rows of 2048, written as matrices and read back."""
    return read_matrices(spark, write_matrices(table(spark, sf_dir, "documents")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's SentencePiece ids and what they decode to, as count and digests."""
    return digests(piece_ids(table(spark, sf_dir, "documents"), decoded=True))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's main language, learned from four fifths of the documents."""
    docs = table(spark, sf_dir, "documents")
    held = language.held_out(F.col("doc_id"))
    model = language.learn(docs.filter("doc_id is not null").filter(~held))
    found = language.identify(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's bytes and tokens, and whether it has more than 1024 tokens."""
    return token_counts(table(spark, sf_dir, "documents"))


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's twenty best documents."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: counts, digest of the patterns' spans, all spans."""
    return secret_scan.digests(secret_scan.find(table(spark, sf_dir, "documents")))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every opening that conversations share, with what its subtree holds."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_url_filters": op2_url_filters,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_pii": op4_pii,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_packing": op7_token_packing,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
    "op11_ranked_lexical_search": op11_ranked_lexical_search,
    "op12_secret_scan": op12_secret_scan,
    "op13_conversation_prefix_trie": op13_conversation_prefix_trie,
}

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t
    FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1),
        lambda i: t[i] || chr(10) || t[i + 1] || chr(10) || t[i + 2]))
        WHEN len(t) > 0 THEN [array_to_string(t, chr(10))] ELSE [] END AS g
    FROM w
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
o AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), r AS (
    SELECT doc_id AS node, doc_id AS reach FROM s
    UNION SELECT r.node, o.b FROM r JOIN o ON o.a = r.reach
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON c.node = s.doc_id
""",
    "op3_benchmark_decontamination": r"""
WITH b AS (
    SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t
    FROM benchmark WHERE item_id IS NOT NULL
), d AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t
    FROM documents WHERE doc_id IS NOT NULL
), bi AS (
    SELECT DISTINCT item_id, least(len(t), 5) AS w, array_to_string(t[i:i + least(len(t), 5) - 1], chr(10)) AS g
    FROM (SELECT item_id, t, unnest(range(1, greatest(len(t) - 4, 1) + 1)) AS i FROM b WHERE len(t) > 0)
), di AS (
    SELECT DISTINCT doc_id, w, array_to_string(t[i:i + w - 1], chr(10)) AS g
    FROM (SELECT doc_id, t, w, unnest(range(1, len(t) - w + 2)) AS i
          FROM d, (SELECT DISTINCT w FROM bi) WHERE len(t) >= w)
), n AS (SELECT item_id, count(*) AS n FROM bi GROUP BY item_id)
SELECT di.doc_id, bi.item_id, n.n AS n_shingles, count(*) AS n_shared, count(*) / n.n AS containment
FROM di JOIN bi ON di.g = bi.g AND di.w = bi.w JOIN n ON n.item_id = bi.item_id
GROUP BY di.doc_id, bi.item_id, n.n HAVING 5 * count(*) >= 4 * n.n
""",
    "op2_url_filters": r"""
WITH RECURSIVE rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
links AS (
    SELECT DISTINCT url, lower(regexp_extract(tag, '(?is)[\s"''/](?:href|content)\s*=\s*["'']([^"'']*)', 1)) AS raw, tag
    FROM (SELECT url, unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g'),
        '(?is)<(?:link|meta)\b[^<>]*>')) AS tag FROM pages)
    WHERE regexp_matches(tag, '(?is)rel\s*=\s*["'']?canonical|http-equiv\s*=\s*["'']?refresh')
), named AS (
    SELECT url, CASE WHEN contains(raw, 'url=') THEN regexp_extract(raw, '(?s)url=(.*)', 1) ELSE raw END AS link FROM links
), urls AS (
    SELECT url FROM pages WHERE contains(url, '://') UNION SELECT link FROM named WHERE contains(link, '://')
), nodes AS (
    SELECT url, regexp_replace(h, ':(80|443)$', '') || CASE WHEN p = '' THEN '/' ELSE p END
        || CASE WHEN q = '?' THEN '' ELSE q END AS node, h, CASE WHEN p = '' THEN '/' ELSE p END AS p
    FROM (SELECT url, lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)) AS h,
        regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS q
        FROM urls) WHERE h <> ''
), edges AS (
    SELECT DISTINCT a.node AS u, b.node AS v FROM named n JOIN nodes a ON a.url = n.url JOIN nodes b ON b.url = n.link
), sides AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (SELECT DISTINCT node, node AS other FROM nodes UNION SELECT r.node, b.v FROM reach r JOIN sides b ON b.u = r.other),
node_rule AS (
    SELECT node, arg_max(verdict, length(rules.h) + length(rules.p)) AS verdict FROM nodes
    JOIN rules ON (nodes.h = rules.h OR ends_with(nodes.h, '.' || rules.h)) AND starts_with(nodes.p, rules.p) GROUP BY node
), bad AS (SELECT DISTINCT r.node FROM reach r JOIN node_rule x ON x.node = r.other AND x.verdict = 'block'),
placed AS (
    SELECT row_number() OVER () AS k, page_id, url, coalesce(lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), fit AS (
    SELECT k, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(verdict, length(h) + length(p)) AS verdict
    FROM placed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k
)
SELECT page_id, host, path, fit.rule,
    coalesce(fit.verdict, CASE WHEN bad.node IS NOT NULL THEN 'block' END, 'allow') AS verdict,
    fit.verdict IS NULL AND bad.node IS NOT NULL AS inherited
FROM placed LEFT JOIN fit ON fit.k = placed.k
LEFT JOIN (SELECT DISTINCT url, node FROM nodes) n ON n.url = placed.url LEFT JOIN bad ON bad.node = n.node
""",
    "op5_embedding_near_dedup": r"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
    SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)
        AND list_dot_product(e, e) > 0
), o AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) >= 0.98 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))
), r AS (
    SELECT vec_id AS node, vec_id AS reach FROM v UNION SELECT r.node, o.b FROM r JOIN o ON o.a = r.reach
), c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM o GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
""",
    "op11_ranked_lexical_search": r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), c AS (SELECT count(*) AS docs, sum(len(t)) AS terms FROM d WHERE len(t) > 0),
i AS (
    SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)
    WHERE item_id IS NOT NULL AND text IS NOT NULL
), q AS (SELECT item_id, text, term, count(*) AS q FROM i GROUP BY ALL),
f AS (
    SELECT r, doc_id, m, term, count(*) AS tf FROM (SELECT r, doc_id, 75 + (25 * len(t) * docs)::BIGINT // terms AS m, unnest(t) AS term FROM d, c)
    SEMI JOIN q USING (term) GROUP BY ALL
), w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term),
s AS (
    SELECT item_id, text, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM f JOIN w USING (term) JOIN q USING (term) GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
""",
    "op12_secret_scan": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
pattern(kind, regex) AS (VALUES ('assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
    ('access', 'AKIA[A-Z0-9]+'), ('hex', '[0-9a-f]+')),
hit AS (
    SELECT r, kind, i, length(gap) + coalesce(length(found), 0) AS size, gap, found, sum(size) OVER (PARTITION BY r, kind ORDER BY i) AS after
    FROM (SELECT r, kind, generate_subscripts(gaps, 1) AS i, unnest(gaps) AS gap, unnest(list_concat(founds, [NULL])) AS found FROM (
        SELECT r, kind, string_split_regex(text, regex) AS gaps, regexp_extract_all(text, regex) AS founds FROM d, pattern
        WHERE regexp_matches(text, regex) OR kind = 'assign'))
), base AS (
    SELECT r, kind, after - length(found) AS b, after AS e FROM hit JOIN pattern USING (kind)
    WHERE found IS NOT NULL AND CASE kind WHEN 'assign' THEN length(regexp_extract(found, regex, 1)) >= 6
        WHEN 'access' THEN length(found) >= 20 ELSE length(found) >= 24 END
), run AS (
    SELECT r, before + after - length(found) AS b, before + after AS e, found FROM (
        SELECT r, i, j, before, found, sum(length(gap) + coalesce(length(found), 0)) OVER (PARTITION BY r, i ORDER BY j) AS after
        FROM (SELECT r, i, before, generate_subscripts(gaps, 1) AS j, unnest(gaps) AS gap, unnest(list_concat(founds, [NULL])) AS found FROM (
            SELECT r, i, after - size AS before, string_split_regex(gap, '[A-Za-z0-9+/_=-]{14,}') AS gaps,
                regexp_extract_all(gap, '[A-Za-z0-9+/_=-]{14,}') AS founds FROM hit WHERE kind = 'assign')))
    WHERE found IS NOT NULL
), named AS (
    SELECT r, b, e, body, CASE
        WHEN regexp_full_match(body, '[0-9a-f]+|[0-9A-F]+') AND digit AND (upp OR low) THEN 'hex'
        WHEN regexp_full_match(body, '[A-Z2-7]+') AND digit AND upp THEN 'base32'
        WHEN regexp_full_match(body, '[A-Za-z0-9+/]+|[A-Za-z0-9_-]+') AND digit AND upp AND low THEN 'base64' END AS encoding
    FROM (SELECT *, regexp_matches(body, '[0-9]') AS digit, regexp_matches(body, '[A-Z]') AS upp, regexp_matches(body, '[a-z]') AS low
        FROM (SELECT *, regexp_replace(found, '=+$', '') AS body FROM run
            WHERE length(found) >= 16 AND NOT regexp_matches(found, '[0-9a-f]{24}|AKIA[A-Z0-9]{16}')))
), edge(band, least) AS (VALUES (0, 16), (1, 24), (2, 32), (3, 48), (4, 64)),
joined AS (SELECT r, string_agg(found, '' ORDER BY b) AS s FROM run WHERE regexp_full_match(found, '[A-Za-z]+') GROUP BY r),
piece AS (
    SELECT DISTINCT band, w, encoding, CASE encoding WHEN 'hex' THEN lower(hex(w[:least // 2])) WHEN 'base32' THEN upper(w) ELSE w END AS s
    FROM (SELECT band, least, unnest(regexp_extract_all(s, '.{' || least || '}')) AS w FROM joined, edge), (VALUES ('hex'), ('base32'), ('base64')) AS v(encoding)
), sample AS (
    SELECT r, b, e, encoding, (SELECT max(band) FROM edge WHERE least <= length(s)) AS band, s FROM (
        SELECT r, b, e, encoding, CASE encoding WHEN 'hex' THEN lower(body) WHEN 'base32' THEN body ELSE translate(body, '-_', '+/') END AS s
        FROM named WHERE encoding IS NOT NULL) WHERE length(s) >= 16
), a(encoding, alphabet, level) AS (VALUES ('hex', '0123456789abcdef', '0000111122223333'),
    ('base32', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', '00000000111111112222222233333333'),
    ('base64', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/', repeat('0', 16) || repeat('1', 16) || repeat('2', 16) || repeat('3', 16))),
x AS (
    SELECT encoding, s, length(s)::DOUBLE AS n, length(alphabet) AS k, translate(s, alphabet, level) AS lv, translate(lv, '0123', '0011') AS hf,
        list_sum(list_transform(string_split(alphabet, ''), lambda c: pow(length(s) - length(replace(s, c, '')), 2))) AS squares
    FROM (SELECT encoding, s FROM piece UNION SELECT encoding, s FROM sample) JOIN a USING (encoding)
), z AS (
    SELECT *, (squares * k / n - n - (k - 1)) / sqrt(2.0 * (k - 1) * (n - 1) / n) AS z1,
        2.0 * length(replace(hf, '1', '')) * length(replace(hf, '0', '')) / n + 1 AS mean, (mean - 1) * (mean - 2) / (n - 1) AS var,
        1 + (length(hf) - length(replace(hf, '01', ''))) / 2 + (length(hf) - length(replace(hf, '10', ''))) / 2 AS runs,
        CASE WHEN var > 0 THEN abs(runs - mean) / sqrt(var) ELSE 40 END AS z2,
        list_sum(list_transform([['01', '1'], ['02', '4'], ['03', '9'], ['10', '1'], ['12', '1'], ['13', '4'], ['20', '4'], ['21', '1'], ['23', '1'],
            ['30', '9'], ['31', '4'], ['32', '1']], lambda p: p[2]::INT * (length(lv) - length(replace(lv, p[1], ''))) / 2)) AS steps,
        abs(steps - 2.5 * (n - 1)) / sqrt(8.25 * (n - 1) + 2.0 * (n - 2)) AS z3
    FROM x
), t AS (
    SELECT encoding, s, least(99, floor(100 * exp(-y) * (1 + y + y * y / 2)))::INT AS bin FROM (SELECT encoding, s,
        ln(1 + exp(least(700, 0.07056 * pow(z1, 3) + 1.5976 * z1))) - least(0, ln(2) - ln(1 + exp(least(700, 0.07056 * pow(z2, 3) + 1.5976 * z2))))
            - least(0, ln(2) - ln(1 + exp(least(700, 0.07056 * pow(z3, 3) + 1.5976 * z3)))) AS y FROM z)
), ww AS (SELECT encoding, band, bin, count(*) AS n FROM (SELECT DISTINCT encoding, band, s, bin FROM piece JOIN t USING (encoding, s)) GROUP BY ALL),
rr AS (
    SELECT encoding, band, bin, sum(n) OVER (PARTITION BY encoding, band ORDER BY bin DESC) AS reported, sum(n) OVER (PARTITION BY encoding, band) AS m
    FROM (SELECT encoding, band, bin, count(*) AS n FROM (SELECT DISTINCT encoding, band, s, bin FROM sample JOIN t USING (encoding, s)) GROUP BY ALL)
), p AS (
    SELECT rr.encoding, rr.band, rr.bin, reported, m, (1 + sum(CASE WHEN ww.bin >= rr.bin THEN ww.n ELSE 0 END)) / (1 + sum(ww.n)) AS p
    FROM rr JOIN ww ON ww.encoding = rr.encoding AND ww.band <= rr.band GROUP BY rr.encoding, rr.band, rr.bin, reported, m, ww.band
), low AS (
    SELECT encoding, band, min(bin) AS bin FROM (SELECT encoding, band, bin, reported, m, min(p) AS p FROM p GROUP BY ALL)
    WHERE p * m <= 0.01 * reported GROUP BY ALL
), extra AS (
    SELECT r, 'random' AS kind, b, e FROM sample JOIN t USING (encoding, s) JOIN low ON low.encoding = sample.encoding AND low.band = sample.band AND t.bin >= low.bin
), spans AS (
    SELECT r, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, list_position(['assign', 'access', 'hex', 'random'], kind)) AS line,
        string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, list_position(['assign', 'access', 'hex'], kind)) FILTER (WHERE kind <> 'random') AS based,
        count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
        count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE kind = 'random') AS n_random
    FROM (SELECT r, kind, b, e FROM base UNION ALL SELECT r, kind, b, e FROM extra) GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(based, '')) AS base_sha256, coalesce(line, '') AS spans, coalesce(n_random, 0) AS n_random FROM d LEFT JOIN spans USING (r)
""",
    "op13_conversation_prefix_trie": r"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        substring(coalesce(role, '') || chr(1) || coalesce(text, ''), 1, 64),
        sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS donor, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
        list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
        lambda crc, d: list_reduce([xor(crc, d), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 9 AS h
    FROM t GROUP BY conv_id
), m AS (
    SELECT c.*, least(c.h, coalesce(d.n, 0)) AS given, least(c.h, coalesce(d.n, 0)) + greatest(c.n - c.h, 0) AS length
    FROM c LEFT JOIN c d ON d.conv_id = c.donor
), r AS (
    SELECT m.conv_id, t.place + 1 AS depth, role, text FROM m JOIN t ON t.conv_id = m.donor AND t.place < m.h
    UNION ALL SELECT m.conv_id, t.place - h + given + 1, role, text FROM m JOIN t ON t.conv_id = m.conv_id AND t.place >= m.h
), k AS (
    SELECT conv_id, depth, octet_length(encode(text)) AS size, sha256(string_agg(octet_length(encode(role)) || ':' || role
        || octet_length(encode(text)) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM r
    UNION ALL SELECT conv_id, 0, 0, '' FROM m
), p AS (SELECT k.*, depth = length AS last, lag(node) OVER (PARTITION BY k.conv_id ORDER BY depth) AS up FROM k JOIN m USING (conv_id)),
n AS (
    SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved,
        sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
    FROM p GROUP BY node, depth
), w AS (SELECT n.*, (SELECT count(*) FROM n c WHERE c.up = n.node AND c.depth = n.depth + 1) AS n_children FROM n),
s AS (
    SELECT p.node, p.depth, sum((w.n_children = 0)::INT) AS n_leaves, sum(w.saved) AS saved_tokens
    FROM w JOIN p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY p.node, p.depth
)
SELECT w.conv_id, w.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves::BIGINT AS n_leaves,
    s.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN s USING (node, depth) LEFT JOIN n u ON u.node = w.up AND u.depth = w.depth - 1
""",
}
