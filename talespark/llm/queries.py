"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, filter_audit, hard_negatives, licenses, mixing, mtree, ordinal, quality, quotes, repeats, simhash, url_rules, warc
from .common import table


#: Fixed rules of the url filter: (verdict, host/path).
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op9_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_by_inner_product(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op1_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal.classify(docs, ordinal.train(docs, table(spark, sf_dir, "labels")))


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.format_conversations(table(spark, sf_dir, "conversations"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest_repeats(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_radix_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


#: Messages that quote the one before, made of conversations; by the turn: its first line, all of it under a lead, or twice nested.
REPLIES = """SELECT conv_id, turn, role, CASE WHEN back IS NULL THEN text WHEN turn % 3 = 1 THEN '> ' || split_part(back, chr(10), 1) || chr(10) || text
 WHEN turn % 3 = 2 THEN role || ' wrote:' || chr(10) || '>' || replace(back, chr(10), chr(10) || '> ') || chr(10) || text
 ELSE '> > ' || split_part(back, chr(10), 1) || chr(10) || '> aside ' || turn || chr(10) || text END AS text
 FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS back FROM conversations)"""


def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's operator over messages that hold quotes, which the table itself does not."""
    rows = table(spark, sf_dir, "conversations")
    made = spark.sql(REPLIES.replace("FROM conversations", "FROM {rows}"), rows=rows)
    return quotes.format_conversations(made)


def _quotes_sql(messages: str) -> str:
    """Quotation linking in SQL: units joined to passages by their text, threads by recursion."""
    blank = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    units = lambda c: rf"list_distinct(list_filter(list_transform(list_concat([{c}], regexp_split_to_array({c}, '\n[ \t]*\n'), string_split({c}, chr(10))), lambda x: trim(regexp_replace(lower(x), '{blank}', ' ', 'g'))), lambda x: x <> ''))"
    return rf"""WITH RECURSIVE msgs AS ({messages}),
lines AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM msgs),
marked AS (SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t>]*>'), '[^>]', '', 'g')) AS level, substr(line, length(regexp_extract(line, '^[ \t>]*>')) + 1) AS body, NOT contains(line, '>') AND regexp_matches(line, '(^|[^\w])(wrote|writes|said|schrieb|escribi[oó]|a écrit)[ \t]*:\s*$') AS leads FROM lines),
runs AS (SELECT *, coalesce(lag(level) OVER w <> level, true) AS fresh, leads AND coalesce(lead(level) OVER w, 0) > 0 AS introduces FROM marked WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
numbered AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM runs),
passages AS (SELECT conv_id, turn, level, string_agg(body, chr(10) ORDER BY i) AS passage FROM numbered WHERE level > 0 GROUP BY conv_id, turn, run, level),
own AS (SELECT conv_id, turn, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0 AND NOT introduces), ''), '^\s+|\s+$', '', 'g') AS words FROM numbered GROUP BY conv_id, turn),
asks AS (SELECT DISTINCT conv_id, turn, level, unnest({units('passage')}) AS unit FROM passages),
units AS (SELECT DISTINCT conv_id, turn, unnest({units('words')}) AS unit FROM own),
met AS (SELECT a.conv_id, a.turn, a.level, a.unit, max(u.turn) AS parent FROM asks a JOIN units u ON u.conv_id = a.conv_id AND u.unit = a.unit AND u.turn < a.turn GROUP BY ALL),
links AS (SELECT conv_id, turn, arg_min(parent, (level, -length(unit), -parent)) AS parent, count(DISTINCT unit) AS n_linked FROM met GROUP BY conv_id, turn),
walk AS (SELECT m.conv_id, m.turn, m.turn AS root, [m.turn] AS path FROM msgs m ANTI JOIN links l ON l.conv_id = m.conv_id AND l.turn = m.turn
 UNION ALL SELECT l.conv_id, l.turn, w.root, list_append(w.path, l.turn) FROM walk w JOIN links l ON l.conv_id = w.conv_id AND l.parent = w.turn),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, root ORDER BY path) - 1 AS place FROM walk),
counted AS (SELECT conv_id, turn, count(*) AS n FROM passages GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, m.role, CASE WHEN contains(m.text, '>') THEN o.words ELSE m.text END AS text, CAST(coalesce(c.n, 0) AS INT) AS n_quotes, CAST(coalesce(l.n_linked, 0) AS INT) AS n_linked, l.parent AS parent_turn, p.root AS root_turn, CAST(len(p.path) - 1 AS INT) AS depth, CAST(p.place AS INT) AS place
FROM msgs m JOIN own o USING (conv_id, turn) JOIN placed p USING (conv_id, turn) LEFT JOIN links l USING (conv_id, turn) LEFT JOIN counted c USING (conv_id, turn)"""


QUERIES = {
    "op1_ordinal": op1_ordinal,
    "op2_quotes": op2_quotes,
    "op3_suffix_array": op3_suffix_array,
    "op4_licenses": op4_licenses,
    "op5_quality_rules": op5_quality_rules,
    "op6_mixing": op6_mixing,
    "op7_bpe": op7_bpe,
    "op8_url_rules": op8_url_rules,
    "op9_mtree": op9_mtree,
    "op10_simhash": op10_simhash,
    "op11_radix_negatives": op11_radix_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_warc": op13_warc,
    "quoted_replies": quoted_replies,
}

#: Quotation linking, the searches by all products, the audit by all orders, and what archives must hold. The others have no SQL form: hashes, FP-growth, fits and tokens are not to be had there.
ORACLE_SQL: dict[str, str] = {
    "op2_quotes": _quotes_sql("SELECT conv_id, turn, role, text FROM conversations"),
    "quoted_replies": _quotes_sql(REPLIES),
    "op9_mtree": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20""",
    "op11_radix_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "op12_filter_audit": r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
 CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
 || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
 || CASE WHEN coalesce(w.doc_id > least, false) THEN 'E' ELSE '' END AS failed FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, failed, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT c.*, filter_order, CAST(step AS INT) AS step, substr(filter_order, CAST(step AS INT), 1) AS letter, coalesce(list_min(list_transform(string_split(nullif(failed, ''), ''), lambda y: instr(filter_order, y))), 6) AS first FROM c, o, range(1, 6) r(step)),
g AS (SELECT part, filter_order, step, letter, CAST(coalesce(sum(n) FILTER (first > step), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (first = step), 0) AS BIGINT) AS removed,
 CAST(coalesce(sum(n) FILTER (contains(failed, letter) AND first < step), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (failed = letter), 0) AS BIGINT) AS unique_fails,
 CAST(coalesce(sum(n) FILTER (first = step AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (first = step AND toxic), 0) AS BIGINT) AS toxic_lost FROM s GROUP BY ALL)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g""",
    "op13_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT *, strlen(h) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, sha1(h) AS payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM m""",
}
