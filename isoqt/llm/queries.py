"""Registered queries of the training-data operators, each over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoqt.llm import (
    bpe, conversation_trie, decontamination, html_extraction, language_id, near_dedup, pii, quality_rules, secret_scans, sharding, token_counts, url_filters, vector_codes,
)
from isoqt.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages show documents, whose number is in the path; a page of low quality or with toxic text is a bad outcome."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))
    key = F.regexp_extract(url_filters.path_of(F.col("url")), r"/([0-9]{1,18})(?:[/.]|$)", 1)
    return url_filters.judge(table(spark, sf_dir, "pages"), labels, F.when(key != "", key.cast("long")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scans.scan(docs, secret_scans.learn(docs))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(table(spark, sf_dir, "documents"), width=4, percent=80)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), shards=24)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.nodes_of(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_quality_rules, op3_secret_scans, op4_near_dedup, op5_sharding, op6_html_extraction, op7_pii, op8_bpe,
                                   op9_language_id, op10_decontamination, op11_vector_codes, op12_token_counts, op13_conversation_trie)}

_SPACES = r"[ \t\n\x0B\f\r]"
_NO_SPACES = r"[^ \t\n\x0B\f\r]"

OP1_SQL = """
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
keyed AS (SELECT *, try_cast(regexp_extract(path, '/([0-9]{1,18})(?:[/.]|$)', 1) AS BIGINT) AS key FROM p),
lab AS (SELECT doc_id AS key, max(greatest(1 - quality, toxic))::DOUBLE AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
hosts AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM keyed LEFT JOIN lab USING (key) GROUP BY host),
named AS (SELECT *, regexp_extract(host, '([^.]+\\.(?:co|com|net|org|ac|gov|edu)\\.[a-z]{2}|[^.]+\\.[^.]*|[^.]*)$', 1) AS domain,
          regexp_extract(host, '([^.]*)$', 1) AS suffix FROM hosts),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
levels AS (SELECT 'h' AS level, n, bad FROM named UNION ALL SELECT 'd', n, bad FROM domains UNION ALL SELECT 's', n, bad FROM suffixes),
stats AS (SELECT level, sum(n) AS t, sum(bad) / sum(n) AS m, count(*) AS g, sum(n * n) AS nn, sum(bad * bad / n) AS bb, sum(bad - bad * bad / n) AS w FROM levels WHERE n > 0 GROUP BY level),
anova AS (SELECT level, m, (bb - t * m * m) / greatest(g - 1, 1) AS msb, w / greatest(t - g, 1) AS msw, (t - nn / t) / greatest(g - 1, 1) AS size FROM stats),
k AS (SELECT level, m, coalesce(CASE WHEN (msb - msw) / nullif(msb + (size - 1) * msw, 0) > 0
        THEN greatest(1.0, least(1000.0, (1 - (msb - msw) / (msb + (size - 1) * msw)) / ((msb - msw) / (msb + (size - 1) * msw)))) END, 1000.0) AS k FROM anova),
ms AS (SELECT suffix, (k * m + bad) / (k + n) AS m_suffix FROM suffixes, k WHERE level = 's'),
md AS (SELECT d.domain, d.suffix, (k * m_suffix + bad) / (k + n) AS m_domain FROM domains d JOIN ms USING (suffix), k WHERE level = 'd'),
post AS (SELECT host, k * m_domain + bad AS a, k * (1 - m_domain) + n - bad AS b FROM named JOIN md USING (domain, suffix), k WHERE level = 'h'),
reputation AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 AS blocked FROM post),
ruled AS (SELECT page_id, host, path, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM keyed)
SELECT page_id, ruled.host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN reputation USING (host)
"""

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
_BOUNDS = {name: (least, most) for name, least, most in quality_rules.RULES}
_WITHIN = " AND ".join(f"coalesce({name} {op} {bound}, false)" for name, (least, most) in _BOUNDS.items() for op, bound in ((">=", least), ("<=", most)) if bound is not None)

OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, doc_id, t, list_filter(string_split_regex(t, '{_SPACES}+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_NO_SPACES}')) AS l FROM d),
win AS (SELECT id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
twice AS (SELECT id, i FROM win WHERE (id, g) IN (SELECT id, g FROM win GROUP BY id, g HAVING count(*) > 1)),
cover AS (SELECT id, count(DISTINCT p) AS n_repeat_words FROM (SELECT id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(t, '[^|]+', '', 'g')) AS n_pipes,
  length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop FROM w LEFT JOIN cover USING (id)),
r AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(word_chars, 0) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
  n_pipes / nullif(n_words, 0) AS pipe_ratio, n_upper / nullif(word_chars, 0) AS upper_ratio, n_stop / nullif(n_words, 0) AS stop_ratio,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {_WITHIN} AS kept FROM r
"""

OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACES}+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT a AS doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(b) AS component_id, min(b) = a AS kept FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a
"""

_FOUR = range(4)
_ENTRIES = ", ".join(f"x{i}" for i in _FOUR)
_APART = " + ".join(f"(p.x{i} - c.x{i}) * (p.x{i} - c.x{i})" for i in _FOUR)


def _assigned(book: str) -> str:
    return f"SELECT p.id, p.part, min(({_APART}) * 64 + c.e) AS best FROM p JOIN {book} c ON p.part = c.part GROUP BY 1, 2"


def _moved(book: str, to: str) -> str:
    floors = ", ".join(f"CASE WHEN n IS NULL THEN c.x{i} ELSE (s{i} - ((s{i} % n) + n) % n) // n END::BIGINT AS x{i}" for i in _FOUR)
    sums = ", ".join(f"sum(x{i})::BIGINT AS s{i}" for i in _FOUR)
    return f"""a_{to} AS ({_assigned(book)}), s_{to} AS (SELECT p.part, best % 64 AS e, count(*) AS n, {sums} FROM p JOIN a_{to} a ON p.id = a.id AND p.part = a.part GROUP BY 1, 2),
{to} AS (SELECT c.part, c.e, {floors} FROM {book} c LEFT JOIN s_{to} s ON c.part = s.part AND c.e = s.e)"""


#: For vectors of 64 dimensions, sixteen parts of four.
OP11_SQL = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, embedding AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT id, k AS part, {", ".join(f"floor(256 * v[4 * k + {i + 1}]::DOUBLE)::BIGINT AS x{i}" for i in _FOUR)} FROM kept, range(16) t(k)),
b0 AS (SELECT part, id - 1 AS e, {_ENTRIES} FROM p WHERE id <= 64),
{_moved("b0", "b1")},
{_moved("b1", "b2")},
f AS ({_assigned("b2")}),
codes AS (SELECT id, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM f GROUP BY id),
book AS (SELECT sha256(string_agg({" || ',' || ".join(f"x{i}" for i in _FOUR)}, ',' ORDER BY part, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (id), book
"""

_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))"

OP13_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor({_CRC}, 4294967295) % 9 AS h, count(*) AS n FROM t GROUP BY conv_id),
k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT k.conv_id, t.i AS d, role, text FROM k JOIN t ON t.conv_id = k.base AND t.i <= k.h UNION ALL SELECT k.conv_id, taken + i - h, role, text FROM k JOIN t USING (conv_id) WHERE i > h),
path AS (SELECT conv_id, d, sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key,
  lag(d) OVER (PARTITION BY conv_id ORDER BY d) AS before, strlen(text) AS bytes FROM r UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM k),
ends AS (SELECT conv_id, max(d) AS d FROM path GROUP BY conv_id),
node AS (SELECT key, d AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
  sha256(coalesce(string_agg(e.conv_id::VARCHAR, ',' ORDER BY e.conv_id), '')) AS ends_sha256 FROM path p LEFT JOIN ends e USING (conv_id, d) GROUP BY key, d),
up AS (SELECT DISTINCT a.key, b.key AS above FROM path a JOIN path b ON a.conv_id = b.conv_id AND b.d = a.d - 1),
under AS (SELECT DISTINCT a.key, b.key AS below FROM path a JOIN path b ON a.conv_id = b.conv_id AND b.d >= a.d),
kids AS (SELECT above AS key, count(*) AS n FROM up GROUP BY above),
sums AS (SELECT u.key, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens, count(*) FILTER (kids.n IS NULL) AS n_leaves FROM under u JOIN node n ON n.key = u.below LEFT JOIN kids ON kids.key = u.below GROUP BY u.key)
SELECT node.conv_id, node.depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, node.ends_sha256
FROM node JOIN sums USING (key) LEFT JOIN kids USING (key) LEFT JOIN up USING (key) LEFT JOIN node parent ON parent.key = up.above
"""

ORACLE = {"op1_url_filters": OP1_SQL, "op2_quality_rules": OP2_SQL, "op4_near_dedup": OP4_SQL, "op11_vector_codes": OP11_SQL, "op13_conversation_trie": OP13_SQL}
