"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.llm import (
    chat_format,
    decontaminate,
    jaccard_join,
    mixing,
    quality_cnn,
    quality_rules,
    secret_scan,
    token_counts,
    url_filter,
    warc_fixity,
)

SP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.leaks(docs, bench)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = secret_scan.find(docs, keep=["doc_id"], repo_col="source")
    of = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("bigint")
    return out.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"), "n_live", "n_example",
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], chats.schema)
    out = chat_format.loss_digest(chat_format.format_chats(chats.unionByName(own)))
    return out.withColumnRenamed("conv", "conv_id")


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality_cnn.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    out = quality_cnn.score(docs, net)
    return out.select("doc_id", quality_cnn.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    a = warc_fixity.tree(warc_fixity.records(pages), "warc-a")
    b = warc_fixity.tree(warc_fixity.records(warc_fixity.damaged(pages)), "warc-b")
    out = warc_fixity.located(a, b)
    return out.select(
        F.col("key").alias("page_id"), "file", F.col("offset_a").alias("offset"), F.col("bytes_a").alias("length"), "kind"
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*names, "n_lines", "n_stop_words", "n_letter_words", "n_bullet_lines", "n_ellipsis_lines")


_OP8_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{SP}'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(list_aggregate(list_concat(ws, ['']), 'string_agg', ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
    len(list_filter(ws, lambda x: lower(x) IN ({", ".join(repr(x) for x in dict.fromkeys(quality_rules.STOP_WORDS))})))::BIGINT AS n_stop_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words,
    len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•]\s')))::BIGINT AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$')))::BIGINT AS n_ellipsis_lines
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words >= 50 AND word_chars / n_words BETWEEN 2 AND 12 AND n_symbols / n_words <= 0.1
  AND n_stop_words >= 2 AND (n_lines = 0 OR (n_dup_lines / n_lines <= 0.3 AND n_bullet_lines / n_lines <= 0.9
  AND n_ellipsis_lines / n_lines <= 0.3)) AND n_letter_words / n_words >= 0.8 AND n_repeat_words / n_words <= 0.5 AS kept
FROM b
"""

def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.join(docs, jaccard_join.Measure(n=4, num=85, den=100))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t,
  coalesce(nullif(regexp_extract(coalesce(text, ''), '{secret_scan.EMAIL}'), ''), coalesce(source, '')) AS owner FROM documents),
p(k, p) AS (VALUES (0, {_sql_text(secret_scan.ASSIGN)}), (1, '{secret_scan.ACCESS}'), (2, '{secret_scan.HEX}'),
  (3, '[A-Za-z0-9+/_=-]{{20,}}')),
f AS (SELECT doc_id, source, owner, k, regexp_extract_all(t, p) AS m, regexp_split_to_array(t, p) AS s FROM d, p WHERE regexp_matches(t, p)),
u AS (SELECT doc_id, source, owner, k, m, s, unnest(range(1, len(m) + 1)) AS i FROM f),
x AS (
  SELECT doc_id, source, owner, k, m[i] AS v,
    CASE WHEN k = 0 THEN regexp_replace(m[i], {_sql_text(secret_scan._ASSIGN_HEAD)}, '') ELSE m[i] END AS val,
    list_sum(list_transform(s[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS st
  FROM u),
y AS (SELECT *, st + length(v) AS en FROM x),
base AS (SELECT * FROM y WHERE k < 3 AND (k <> 0 OR length(val) >= 6)),
maybe AS (
  SELECT * FROM y WHERE k = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 10
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = y.doc_id AND b.st < y.en AND y.st < b.en)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM maybe),
live AS (SELECT val FROM every GROUP BY val HAVING count(DISTINCT owner) <= {secret_scan.MAX_OWNERS} AND count(DISTINCT source) <= {secret_scan.MAX_REPOS}),
z AS (
  SELECT doc_id, k, st, ['assign', 'access', 'hex', 'random'][k + 1] || ':' || st || ':' || en AS s, val IN (SELECT val FROM live) AS l FROM every),
g AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
    string_agg(s, ',' ORDER BY st, k) FILTER (k < 3) AS b, string_agg(s, ',' ORDER BY st, k) FILTER (k < 3 OR l) AS a,
    count(*) FILTER (k < 3 AND l) AS nl, count(*) FILTER (k < 3 AND NOT l) AS ne
  FROM z GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, coalesce(nl, 0)::BIGINT AS n_live, coalesce(ne, 0)::BIGINT AS n_example
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

_OP2_SQL = f"""
WITH i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SP}'), lambda x: x <> '') AS ws
  FROM benchmark),
iw AS (SELECT *, least(5, len(ws)) AS k FROM i WHERE len(ws) > 0),
ish AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS p FROM iw)),
n AS (SELECT item_id, count(*) AS n FROM ish GROUP BY item_id),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SP}'), lambda x: x <> '') AS ws
  FROM documents),
dsh AS (
  SELECT DISTINCT doc_id, k, array_to_string(ws[p:p + k - 1], ' ') AS s
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw) WHERE len(ws) >= k)),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM dsh JOIN ish USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, m.item_id, n::BIGINT AS n_shingles, shared::BIGINT AS n_shared, round(shared / n, 6) AS containment
FROM m JOIN n ON m.item_id = n.item_id WHERE 100 * shared >= 80 * n
"""
_OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (
  SELECT *, 12 + 1 + 10 + 1 + length(role) + length(text) + len(regexp_extract_all(text,
    '[<\[]\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)')) AS f FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(f)::BIGINT AS formatted_chars, 0::INT AS rewrites
FROM x GROUP BY conv_id
"""

_OP6_SQL = f"""
WITH r AS (
  SELECT page_id, page_id // {warc_fixity.FILE_PLACES} AS file,
    strlen('WARC/1.0..WARC-Type: resource..WARC-Target-URI: ' || coalesce(url, '') || '..WARC-Date: {warc_fixity.DATE}..WARC-Record-ID: <urn:page:'
      || page_id || '>..Content-Type: text/html..Content-Length: ' || strlen(coalesce(html, '')) || '....' || coalesce(html, '') || '....') AS length
  FROM pages),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM r)
SELECT page_id, file, "offset", length::BIGINT AS length, CASE WHEN page_id % 211 = 11 THEN 'missing' ELSE 'changed' END AS kind
FROM o WHERE page_id % 211 = 11 OR page_id % 101 = 7
"""

_OP10_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SP}'), lambda x: x <> '') AS ws
  FROM documents),
k AS (SELECT *, least(4, len(ws)) AS k FROM d WHERE len(ws) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS p FROM k)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
m AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM m JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.c = e.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_decontaminate": op2_decontaminate,
    "op3_secret_scan": op3_secret_scan,
    "op4_chat_format": op4_chat_format,
    "op5_quality_cnn": op5_quality_cnn,
    "op6_warc_fixity": op6_warc_fixity,
    "op7_mixing": op7_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_counts": op9_token_counts,
    "op10_jaccard_join": op10_jaccard_join,
}
_SQL = {
    "op2_decontaminate": _OP2_SQL,
    "op3_secret_scan": _OP3_SQL,
    "op4_chat_format": _OP4_SQL,
    "op10_jaccard_join": _OP10_SQL,
    "op6_warc_fixity": _OP6_SQL, "op8_quality_rules": _OP8_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
