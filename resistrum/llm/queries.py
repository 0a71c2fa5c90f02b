"""The thin queries over whole tables, one per operator, and the SQL that says what some of them return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resistrum.llm import bpe, fim, html, langid, linededup, media, merkle, minhash, mixing, quality, simhash, urlfilter, warc
from resistrum.llm.common import new_path, table

URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = minhash.classes(docs, shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) = 1 THEN ws
         ELSE list_sort(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) END AS shingles
  FROM w
),
sets AS (SELECT shingles, len(shingles) AS n, min(doc_id) AS node FROM s WHERE len(shingles) > 0 GROUP BY shingles),
e AS (SELECT node, n, unnest(shingles) AS x FROM sets),
p AS (
  SELECT a.node AS a, b.node AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.node < b.node AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
links AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT node, node AS other FROM sets UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other),
named AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM s LEFT JOIN sets ON s.shingles = sets.shingles LEFT JOIN named USING (node)
"""


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urlfilter.judged(table(spark, sf_dir, "pages"), rules)


OP3_SQL = """
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rule_host, rule_path, rule_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict FROM p JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
),
best AS (SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(rule_verdict, length(rule)) AS verdict FROM fits GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id, host, path)
"""


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
o AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0) AS remaining,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS sharing
  FROM s WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
level AS (SELECT remaining, sharing FROM o WHERE 3 * source_size::HUGEINT * sharing >= remaining::HUGEINT * weight ORDER BY sharing DESC, remaining DESC LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN 3 * source_size::HUGEINT * sharing < level.remaining::HUGEINT * weight THEN (3 * source_size)::DOUBLE
         ELSE level.remaining::DOUBLE * weight / level.sharing::DOUBLE END AS target
  FROM s CROSS JOIN level
),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, text, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = langid.fitted(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return langid.predicted(docs.select("doc_id", "text"), filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    sized = docs.withColumn("n_bytes", F.length("bytes").cast("long"))
    padded = sized.select("doc_id", "n_bytes", F.expr("rpad(bytes, cast(greatest(64, 64 * ceil(n_bytes / 64)) AS INT), X'00')").alias("payload"))
    kept = media.stored(padded, "payload").drop("payload")
    return media.facts(kept).drop("media")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extracted(pages, html.learned(pages))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.encode("html", "UTF-8").alias("payload"))
    path = new_path(spark, "warc")
    warc.write_archive(pages, path)
    return warc.read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS leader FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < leader THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < leader THEN leader END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", "n_lines", "n_capitals")


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS five FROM w WHERE len(ws) >= 5),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, (SELECT unnest(range(5)) AS k) WHERE n > 1 GROUP BY doc_id),
f AS (
  SELECT doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(regexp_extract_all(t, '\p{Lu}')) AS n_capitals, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)
),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
rated AS (
  SELECT doc_id, lang, base_failed, unnest(['symbols', 'lines', 'repeats', 'capitals']) AS rule,
         unnest([CASE WHEN word_chars > 0 THEN least(ceil(n_symbols * 50 / word_chars), 50) ELSE 0 END, CASE WHEN n_lines > 0 THEN least(ceil(n_dup_lines * 50 / n_lines), 50) ELSE 0 END,
                 CASE WHEN n_words > 0 THEN least(ceil(n_repeat_words * 50 / n_words), 50) ELSE 0 END, CASE WHEN word_chars > 0 THEN least(ceil(n_capitals * 50 / word_chars), 50) ELSE 0 END])::INT AS step
  FROM b
),
q AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality)),
m AS (SELECT lang, rule, step, good FROM rated JOIN q USING (doc_id) WHERE NOT base_failed),
k AS (
  SELECT lang, rule, i, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE NOT good) AS n_bad, count(*) FILTER (WHERE good AND step > i) AS k_good,
         count(*) FILTER (WHERE NOT good AND step > i) AS k_bad
  FROM m, (SELECT unnest(range(50)) AS i) GROUP BY ALL
),
t AS (
  SELECT *, CASE WHEN k_good >= n_good * 0.0125 THEN 1 ELSE list_sum(list_transform(range(k_good + 1), lambda x:
         exp(lgamma(n_good + 1) - CASE WHEN x > 0 THEN lgamma(x + 1) ELSE 0 END - lgamma(n_good - x + 1) + x * ln(0.0125::DOUBLE) + (n_good - x) * ln(1 - 0.0125::DOUBLE)))) END
         <= 0.05 / (4 * (SELECT count(*) FROM (SELECT DISTINCT lang FROM m))) AS safe
  FROM k
),
held AS (SELECT *, bool_and(safe) OVER (PARTITION BY lang, rule ORDER BY i DESC) AS held FROM t),
best AS (
  SELECT lang, rule, arg_max(i, (margin, i)) AS cut, max(margin) AS margin
  FROM (SELECT *, CASE WHEN n_bad > 0 THEN k_bad / n_bad ELSE 0 END - CASE WHEN n_good > 0 THEN k_good / n_good ELSE 0 END AS margin FROM held WHERE held) GROUP BY lang, rule
),
over AS (SELECT DISTINCT doc_id FROM rated JOIN best ON rated.rule = best.rule AND rated.lang IS NOT DISTINCT FROM best.lang WHERE margin > 0 AND step > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND over.doc_id IS NULL AS kept, n_lines, n_capitals
FROM b LEFT JOIN over USING (doc_id)
"""


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"), fim.LETTER_RUNS)
    lengths = (F.char_length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", F.col("n_units").alias("n"), "form", *lengths, F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
),
h AS (SELECT *, list_transform(range(4), lambda k: ('0x' || substr(d, 1 + 8 * k, 8))::BIGINT) AS h FROM u),
c AS (
  SELECT *, least(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS a, greatest(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
),
x AS (
  SELECT *, array_to_string(us[1:a], '') AS prefix, array_to_string(us[a + 1:b], '') AS middle, array_to_string(us[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, len(us)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM x
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaf = merkle.digest(*fields, F.col("text"))
    claim = F.when(changed, merkle.digest(*fields, F.translate("text", upper, lower))).otherwise(leaf)
    made = merkle.manifest(docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("tree"), leaf.alias("leaf"), claim.alias("claim")))
    folded = made.withColumn("folded_root", merkle.folded(F.col("claim"), F.col("proof")))
    return folded.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_digest(*fields: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


OP12_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
d AS (
  SELECT *, {_sql_digest("doc_id", "source", "lang", "n_chars", "text")} AS leaf, {_sql_digest("doc_id", "source", "lang", "n_chars", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS code
  FROM documents, crc
),
n AS (
  SELECT doc_id, lang, leaf, CASE WHEN code % 3 = 0 THEN lowered ELSE leaf END AS claim, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d
),
up AS (
  SELECT lang, 0 AS level, i, leaf AS h, n FROM n
  UNION ALL
  SELECT lang, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY lang, level, i // 8, n
),
sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, t AS i, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY level, i // 8, n
),
steps AS (
  SELECT n.lang, n.i, u.level, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i < n.i >> (3 * u.level)), '') AS before, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i > n.i >> (3 * u.level)), '') AS after
  FROM n JOIN up u ON n.lang IS NOT DISTINCT FROM u.lang AND u.n > 1 AND u.i // 8 = n.i >> (3 * u.level + 3) GROUP BY ALL
  UNION ALL
  SELECT n.lang, n.i, 100 + u.level, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i < s.t >> (3 * u.level)), ''), coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i > s.t >> (3 * u.level)), '')
  FROM n JOIN sub s ON n.lang IS NOT DISTINCT FROM s.lang JOIN top u ON u.n > 1 AND u.i // 8 = s.t >> (3 * u.level + 3) GROUP BY ALL
),
path AS (SELECT *, row_number() OVER (PARTITION BY lang, i ORDER BY level) - 1 AS k FROM steps),
fold AS (
  SELECT lang, i, 0 AS k, claim AS h FROM n
  UNION ALL
  SELECT f.lang, f.i, f.k + 1, sha256(before || h || after) FROM fold f JOIN path p ON f.lang IS NOT DISTINCT FROM p.lang AND f.i = p.i AND f.k = p.k
),
ends AS (SELECT lang, i, arg_max(h, k) AS folded_root FROM fold GROUP BY lang, i),
proofs AS (SELECT lang, i, string_agg(before || after, '' ORDER BY k) AS siblings FROM path GROUP BY lang, i)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = (SELECT h FROM top WHERE n = 1) AS verified
FROM n JOIN sub s ON n.lang IS NOT DISTINCT FROM s.lang JOIN ends e ON n.lang IS NOT DISTINCT FROM e.lang AND n.i = e.i LEFT JOIN proofs p ON n.lang IS NOT DISTINCT FROM p.lang AND n.i = p.i
"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_minhash": op2_minhash,
    "op3_url_filters": op3_url_filters,
    "op4_source_mixing": op4_source_mixing,
    "op5_language_id": op5_language_id,
    "op6_media": op6_media,
    "op7_html": op7_html,
    "op8_warc": op8_warc,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_merkle": op12_merkle,
    "op13_simhash": op13_simhash,
}
ORACLE_SQL: dict[str, str] = {"op2_minhash": OP2_SQL, "op3_url_filters": OP3_SQL, "op4_source_mixing": OP4_SQL, "op8_warc": OP8_SQL, "op10_quality_rules": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_merkle": OP12_SQL}
