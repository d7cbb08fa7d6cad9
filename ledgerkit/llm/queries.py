"""Registered queries of the training-data operators: thin calls with production
parameters over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerkit.llm import exact_dedup, host_rules, line_dedup, merkle, mixing, near_dup, packing, pii, quality_crf, substring_dedup, token_align, token_store, warc
from ledgerkit.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query("op8_exact_dedup", """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
             max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
      FROM documents)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.resolve(table(spark, sf_dir, "documents"), largest=True)


# The keys of one document's lines are made by list functions; a run of the same key in
# several lines of a document counts once.
@query("op3_line_dedup", """
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, i, line, f.key IS NOT NULL AND doc_id <> f.keeper AS dropped
  FROM lines LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)


_POSITION = mixing.position_sql(mixing.SCHEDULES, "rank", "u")


@query("op2_mixing", f"""
WITH docs AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix:' || doc_id::VARCHAR) AS place FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM docs GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight, 2 * source_size AS cap FROM sources),
-- sources in the order in which a rising level caps them; the level after the first k caps
capped AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER below, 0)) / (sum(weight) OVER ()- coalesce(sum(weight) OVER below, 0)) AS level
  FROM weighed WINDOW below AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT level FROM capped WHERE weight * level <= cap ORDER BY cap::DOUBLE / weight, rank LIMIT 1),
targets AS (SELECT *, least(cap::DOUBLE, weight * (SELECT level FROM final)) AS target FROM weighed),
placed AS (
  SELECT d.*, source_size, rank, target, floor(target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, CASE WHEN 2 * least(size, budget - start) >= size THEN size ELSE 0 END AS first_words,
         CASE WHEN 2 * least(size, budget - start - source_size) >= size THEN size ELSE 0 END AS second_words FROM placed),
timed AS (SELECT *, least((start + first_words / 2) / nullif(target, 0), 1) AS u FROM taken)
SELECT doc_id, size, source_size, target, (first_words + second_words)::BIGINT AS taken,
       CASE WHEN first_words > 0 THEN {_POSITION} END AS position
FROM timed
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


@query("op10_warc", """
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
owned AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS owner FROM hashed)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(sha, (i // 4)::INT * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM owned
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = warc.normalise(warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=0))
    return warc.read_archives(normal, payloads=False).drop("url", "payload")


@query("op5_host_rules", """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, length(words) - 6)) AS i, words FROM d WHERE length(words) >= 8),
keyed AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS k FROM w),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed) WHERE n >= 2),
cover AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
          FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
         WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (
  SELECT doc_id, source, length(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN cover USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
-- one row per document and rule
rules AS (
  SELECT source, unnest(['short', 'repeats', 'symbols', 'dup_lines', 'word_length']) AS rule,
         unnest([n_words < 20, 100 * n_repeat_words > 30 * n_words, 100 * n_symbols > 10 * n_words, 100 * n_dup_lines > 30 * n_lines,
                 word_chars < 3 * n_words OR word_chars > 12 * n_words]) AS hit FROM judged),
hosts AS (SELECT source, rule, count(*) AS n, count(*) FILTER (hit) AS failed FROM rules GROUP BY source, rule),
moments AS (SELECT rule, avg(failed / n) AS mean, var_pop(failed / n) AS var FROM hosts GROUP BY rule),
prior AS (SELECT rule, mean, CASE WHEN var > 0 THEN least(1e6, greatest(0, mean * (1 - mean) / var - 1)) ELSE 1e6 END AS strength FROM moments),
verdicts AS (SELECT source, bool_or((failed + mean * strength) / (n + strength) > 0.5) AS host_failed FROM hosts JOIN prior USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents"))


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op4_quality_crf")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_crf.score(docs, quality_crf.train(docs, table(spark, sf_dir, "labels")))


@query("op6_near_dup", """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN length(words) = 0 THEN []
                      WHEN length(words) < 3 THEN [array_to_string(words, ' ')]
                      ELSE list_distinct(list_transform(range(1, length(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS shingles
  FROM d),
classes AS (SELECT min(doc_id) AS id, list_sort(shingles) AS shingles FROM sets WHERE length(shingles) > 0 GROUP BY list_sort(shingles)),
tokens AS (SELECT id, unnest(shingles) AS token, length(shingles) AS n FROM classes),
common AS (SELECT a.id AS x, b.id AS y, a.n + b.n AS total, count(*) AS i
           FROM tokens a JOIN tokens b ON a.token = b.token AND a.id < b.id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
           GROUP BY ALL),
links AS (SELECT x, y FROM common WHERE 100 * i >= 90 * (total - i)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT id AS x, id AS y FROM classes UNION SELECT r.x, b.y FROM reach r JOIN ways b ON r.y = b.x),
roots AS (SELECT x AS id, min(y) AS root FROM reach GROUP BY x)
SELECT s.doc_id, length(s.shingles)::BIGINT AS n_shingles, coalesce(r.root, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON list_sort(s.shingles) = c.shingles LEFT JOIN roots r USING (id)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.components(table(spark, sf_dir, "documents"), words=3, percent=90)


@query("op7_substring_dedup", """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
      FROM (SELECT doc_id, words, unnest(range(1, length(words) - 48)) AS i FROM d WHERE length(words) >= 50)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS low FROM w) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
kept AS (SELECT e.doc_id, count(*) AS n_removed_not, string_agg(word, ' ' ORDER BY e.i) AS text
         FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT d.doc_id, length(words)::BIGINT AS n_words, (length(words) - coalesce(n_removed_not, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedupe(table(spark, sf_dir, "documents"), span=50)


# crc32 by its rule: every byte is xored in, then come eight shifts.
@query("op11_merkle", """
WITH RECURSIVE crc AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
           lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc FROM documents),
fields AS (
  SELECT doc_id, lang, crc % 7 = 0 AS hit,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS n_more,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents JOIN crc USING (doc_id)),
leaves AS (
  SELECT doc_id, lang, sha256(head || n || tail) AS leaf, sha256(head || CASE WHEN hit THEN n_more ELSE n END || tail) AS found,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM fields),
tree AS (
  SELECT 0 AS level, lang, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, lang, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY level, lang, pos // 2, n),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
-- a step of a path: the side of the sibling and the sibling, or '-' without one
low AS (SELECT a.level, a.lang, a.pos, CASE WHEN b.pos IS NULL THEN '-' WHEN b.pos < a.pos THEN 'L' || b.h ELSE 'R' || b.h END AS step
        FROM tree a LEFT JOIN tree b ON a.level = b.level AND a.lang IS NOT DISTINCT FROM b.lang AND b.pos = xor(a.pos, 1) WHERE a.n > 1),
high AS (SELECT a.level, a.pos, CASE WHEN b.pos IS NULL THEN '-' WHEN b.pos < a.pos THEN 'L' || b.h ELSE 'R' || b.h END AS step
         FROM top a LEFT JOIN top b ON a.level = b.level AND b.pos = xor(a.pos, 1) WHERE a.n > 1),
steps AS (
  SELECT doc_id, level, step FROM leaves d JOIN low s ON d.lang IS NOT DISTINCT FROM s.lang AND s.pos = d.pos >> s.level
  UNION ALL
  SELECT doc_id, 1000 + level, step FROM leaves d JOIN subroots r ON d.lang IS NOT DISTINCT FROM r.lang JOIN high s ON s.pos = r.pos >> s.level),
paths AS (SELECT doc_id, list(step ORDER BY level) AS steps, sha256(string_agg(substr(step, 2), '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY doc_id),
folded AS (
  SELECT d.doc_id, d.lang, leaf, coalesce(proof_sha256, sha256('')) AS proof_sha256,
         list_reduce(list_concat([found], coalesce(steps, [])),
           lambda h, s: CASE WHEN s = '-' THEN sha256(h) WHEN s[1] = 'L' THEN sha256(substr(s, 2) || h) ELSE sha256(h || substr(s, 2)) END) AS folded_root
  FROM leaves d LEFT JOIN paths USING (doc_id))
SELECT doc_id, leaf, r.h AS subroot, t.h AS root, proof_sha256, folded_root, folded_root = t.h AS verified
FROM folded f JOIN subroots r ON f.lang IS NOT DISTINCT FROM r.lang JOIN top t ON t.n = 1
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.proofs(merkle.build(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op12_token_align")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.scored(table(spark, sf_dir, "documents"))


@query("op13_token_store")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.digest(spark, token_store.write(table(spark, sf_dir, "documents")))
