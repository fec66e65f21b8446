"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_warc, op2_html, op3_embeddings, op4_mixing, op5_quality, op6_minhash, op7_substrings, op8_lines, op9_token_counts, op10_sentencepiece, op11_filter_audit, op12_spelling, op13_chat

# SQL on the same tables for the engine that checks the results ---------------------------------------------------

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1_SQL = r"""
WITH p AS (
  SELECT page_id, url, html, CASE WHEN html IS NOT NULL THEN '"' || md5(html) || '"' END AS tag, strlen(html) AS bytes, 1704067200 + 60 * page_id AS t FROM pages),
q AS (SELECT *, t + 60 * (bytes % 10080) - 86400 AS rt,
  CASE WHEN contains(url, '#') THEN '"' || md5(url) || '"' WHEN contains(url, '?') THEN NULL WHEN starts_with(url, 'https') THEN 'W/' || tag ELSE tag END AS rtag,
  CASE WHEN contains(url, '?') THEN t - 3600 END AS rmod FROM p),
k AS (SELECT *, regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) AS host, regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-zA-Z]+://[^/?#]*', '') AS rest FROM q),
u AS (SELECT *, CASE WHEN url IS NULL OR host = '' THEN NULL ELSE regexp_replace(host, '^www\.', '') || CASE WHEN rtrim(regexp_replace(rest, '\?.*$', ''), '/') = '' THEN '/' ELSE rtrim(regexp_replace(rest, '\?.*$', ''), '/') END
        || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)='))), '&'), ''), '') END AS key FROM k),
f AS (SELECT key, t, page_id, tag, bytes, t - 3600 AS mod FROM u WHERE html IS NOT NULL AND key IS NOT NULL),
j AS (SELECT u.page_id, u.key, u.rt, u.rtag, u.rmod, max((f.t, 'response-' || f.page_id, f.tag, f.bytes, f.mod)) AS m FROM u LEFT JOIN f ON f.key = u.key AND f.t < u.rt GROUP BY ALL),
r AS (SELECT *, CASE WHEN key IS NULL THEN 'no-url' WHEN m[1] IS NULL THEN 'no-response' WHEN rtag IS NULL AND rmod IS NULL THEN 'no-validator'
   WHEN rtag IS NOT NULL AND regexp_replace(rtag, '^W/', '') IS DISTINCT FROM m[3] THEN 'changed' WHEN rtag IS NULL AND rmod <> m[5] THEN 'changed' ELSE 'resolved' END AS outcome FROM j)
SELECT 'revisit-' || page_id AS record_id, key AS url_key, CASE WHEN outcome = 'resolved' THEN m[2] END AS refers_to, outcome,
   CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || m[4] || chr(10) || 'content-type: text/html; charset=utf-8' || chr(10) || 'date: ' || rt || chr(10)
        || 'etag: ' || coalesce(rtag, m[3]) || chr(10) || 'last-modified: ' || coalesce(rmod, m[5]) || chr(10) || 'server: archive' || chr(10) || 'x-cache: revalidated' END AS headers
FROM r
"""

OP2_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS x FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(x, '</?(p|h1)>', chr(1), 'g'), '<[^>]*>', ' ', 'g'), chr(1)) AS bs FROM a),
c AS (SELECT page_id, url, [trim(regexp_replace(replace(replace(replace(regexp_replace(y, '&amp;?', chr(2), 'g'), '&quot;', '"'), '&lt;', '<'), chr(2), '&'), '\s+', ' ', 'g')) for y in bs] AS bs FROM b),
d AS (SELECT page_id, url, array_to_string([y for y in bs if y <> ''], chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""

OP3_SQL = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
g AS (SELECT * FROM v WHERE ok),
l AS (SELECT a.rid AS a, b.rid AS b FROM g a JOIN g b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT rid AS node, vec_id AS least FROM g UNION SELECT l.b, r.least FROM r JOIN l ON l.a = r.node JOIN v ON v.rid = l.b WHERE v.vec_id IS NULL OR r.least < v.vec_id),
m AS (SELECT node, min(least) AS least FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(m.least, vec_id) AS component_id, coalesce(vec_id = coalesce(m.least, vec_id), false) AS kept
FROM v LEFT JOIN m ON m.node = v.rid LEFT JOIN n ON n.a = v.rid
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS w FROM s),
c AS (SELECT *, (2 * source_size)::DOUBLE AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS want,
        coalesce(sum((2 * source_size)::DOUBLE) OVER lv, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER lv, 0) AS open
      FROM w WINDOW lv AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (want - capped) / open AS lv FROM c),
t AS (SELECT source, source_size, CASE WHEN m IS NULL THEN cap ELSE least(cap, m * w) END AS target
      FROM (SELECT *, min_by(lv, capped) FILTER (WHERE lv * w <= cap) OVER () AS m FROM l)),
r AS (SELECT d.doc_id, d.size, d.h, t.*, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, target - whole * source_size AS left_over, sum(size) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
             sum(size) OVER (PARTITION BY source, h) AS tied FROM r),
x AS (SELECT *, upto - tied AS below FROM k)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (whole + CASE WHEN upto <= left_over THEN 1 WHEN below <= left_over AND upto - left_over < left_over - below THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT *, row_number() OVER () AS rid, [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] AS g FROM d),
u AS (SELECT rid, unnest(g) AS gram, unnest(range(len(g))) AS i FROM g),
rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS n FROM u) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM g LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, word_chars::DOUBLE / greatest(n_words, 1) AS r1,
        n_symbols::DOUBLE / greatest(n_words, 1) AS r2, n_dup_lines::DOUBLE / greatest(n_lines, 1) AS r3, n_repeat_words::DOUBLE / greatest(n_words, 1) AS r4 FROM m),
e AS (SELECT lang, source, unnest([1, 2, 3, 4]) AS k, unnest([r1, r2, r3, r4]) AS v FROM b WHERE NOT base_failed),
p AS (SELECT *, row_number() OVER (PARTITION BY k, lang, source ORDER BY v) AS i0, count(*) OVER (PARTITION BY k, lang, source) AS n0,
        row_number() OVER (PARTITION BY k, lang ORDER BY v) AS i1, count(*) OVER (PARTITION BY k, lang) AS n1,
        row_number() OVER (PARTITION BY k ORDER BY v) AS i2, count(*) OVER (PARTITION BY k) AS n2 FROM e),
q0 AS (SELECT lang, source, k, max(n0) AS n0, min(v) FILTER (WHERE i0 >= ceil(0.25 * n0)) AS a0, min(v) FILTER (WHERE i0 >= ceil(0.75 * n0)) AS c0 FROM p GROUP BY ALL),
q1 AS (SELECT lang, k, max(n1) AS n1, min(v) FILTER (WHERE i1 >= ceil(0.25 * n1)) AS a1, min(v) FILTER (WHERE i1 >= ceil(0.75 * n1)) AS c1 FROM p GROUP BY ALL),
q2 AS (SELECT k, min(v) FILTER (WHERE i2 >= ceil(0.25 * n2)) AS a2, min(v) FILTER (WHERE i2 >= ceil(0.75 * n2)) AS c2 FROM p GROUP BY ALL),
q AS (SELECT q0.lang, q0.source, q0.k, CASE WHEN n0 >= 200 THEN a0 WHEN n1 >= 200 THEN a1 ELSE a2 END AS a,
        CASE WHEN n0 >= 200 THEN c0 WHEN n1 >= 200 THEN c1 ELSE c2 END AS c, ([0.5, 0.03, 0.1, 0.1])[q0.k]::DOUBLE AS least
      FROM q0 JOIN q1 ON q0.k = q1.k AND q0.lang IS NOT DISTINCT FROM q1.lang JOIN q2 ON q2.k = q0.k),
f AS (SELECT lang, source, max(a - 3.0::DOUBLE * greatest(c - a, least)) FILTER (WHERE k = 1) AS lo1, max(c + 3.0::DOUBLE * greatest(c - a, least)) FILTER (WHERE k = 1) AS hi1,
        max(c + 3.0::DOUBLE * greatest(c - a, least)) FILTER (WHERE k = 2) AS hi2, max(c + 3.0::DOUBLE * greatest(c - a, least)) FILTER (WHERE k = 3) AS hi3,
        max(c + 3.0::DOUBLE * greatest(c - a, least)) FILTER (WHERE k = 4) AS hi4 FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND r1 BETWEEN lo1 AND hi1 AND r2 <= hi2 AND r3 <= hi3 AND r4 <= hi4, false) AS kept
FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS g FROM d),
c AS (SELECT list_sort(g) AS g, min(doc_id) AS rep FROM s GROUP BY 1),
e AS (SELECT rep, len(g) AS n, hash(unnest(g)) AS x FROM c WHERE len(g) > 0),
o AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM o WHERE 100 * k >= 75 * (na + nb - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS node, rep AS least FROM c WHERE len(g) > 0 UNION SELECT u.b, r.least FROM r JOIN u ON u.a = r.node WHERE r.least < u.b),
m AS (SELECT node, min(least) AS least FROM r GROUP BY node)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(m.least, s.doc_id) AS component_id, s.doc_id = coalesce(m.least, s.doc_id) AS kept
FROM s JOIN c ON list_sort(s.g) = c.g LEFT JOIN m ON m.node = c.rep AND len(s.g) > 0
"""

OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT rid, doc_id, unnest(range(1, len(w) - 11)) AS i, unnest([sha256(array_to_string(w[i:i + 12], ' ')) for i in range(1, len(w) - 11)]) AS g FROM d),
f AS (SELECT rid, i FROM (SELECT *, min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY g) AS least FROM g) WHERE least < coalesce(doc_id, 9223372036854775807)),
c AS (SELECT DISTINCT rid, i + k AS i FROM f, (SELECT unnest(range(13)) AS k)),
r AS (SELECT rid, list(i) AS gone FROM c GROUP BY rid),
k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN r USING (rid))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN len(gone) = 0 THEN w ELSE [x for x, i in w if NOT list_contains(gone, i)] END, ' '), '')) AS kept_sha256
FROM k
"""


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(range(len(ls))) AS no, unnest(ls) AS line FROM d),
l AS (SELECT * FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS (SELECT line, strlen(line) AS n, min((doc_id, no)) AS o, row_number() OVER (ORDER BY line) AS k FROM l GROUP BY line),
e AS (SELECT a.k AS a, b.k AS b FROM c a JOIN c b ON a.n BETWEEN 24 AND b.n AND b.n - a.n <= 2 AND a.k <> b.k
      AND (substr(a.line, 1, 8) = substr(b.line, 1, 8) OR substr(a.line, -8) = substr(b.line, -8) OR contains(b.line, substr(a.line, 9, length(a.line) - 16)) OR length(a.line) < 64)
      AND levenshtein(a.line, b.line) <= 2),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT k AS node, o AS least FROM c UNION SELECT u.b, r.least FROM r JOIN u ON u.a = r.node JOIN c ON c.k = u.b WHERE r.least < c.o),
m AS (SELECT node, min(least) AS least FROM r GROUP BY node),
g AS (SELECT l.doc_id, l.no, (l.doc_id, l.no) = c.o AS near FROM l JOIN c USING (line) JOIN m ON m.node = c.k WHERE (l.doc_id, l.no) > m.least),
s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE near) AS near, string_agg((no + 1)::VARCHAR, ',' ORDER BY no) AS removed FROM g GROUP BY doc_id)
SELECT d.doc_id, len(list_filter(ls, lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines, coalesce(s.n, 0)::BIGINT AS n_removed,
       coalesce(s.near, 0)::BIGINT AS n_near, coalesce(s.removed, '') AS removed
FROM d LEFT JOIN s USING (doc_id)
"""


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY t) < coalesce(doc_id, 9223372036854775807) THEN 16 ELSE 0 END AS mask FROM d),
g AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest([1, 2, 4, 8, 16]) AS b, unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INTEGER AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
      FROM g, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""

OP12_SQL = r"""
WITH RECURSIVE b AS (SELECT list(list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS m FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
y AS (SELECT run, m, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END for c in string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, '')]) AS bytes FROM d),
h AS (SELECT run, m, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes::BIGINT[]), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM y, b),
q AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, m FROM h),
v AS (SELECT word, sum(m)::BIGINT AS n FROM q WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
p AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
k AS (SELECT word, n, i, word[:i] || '-' || word[i + 2:] AS gap, word[:i] || word[i + 2:] AS rest FROM p),
e AS (SELECT x.word, y.word AS near, y.n AS near_n FROM k x JOIN k y ON x.gap = y.gap AND x.word <> y.word
      UNION SELECT k.word, v.word, v.n FROM k JOIN v ON v.word = k.rest UNION SELECT v.word, k.word, k.n FROM k JOIN v ON v.word = k.rest),
t AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS best FROM e GROUP BY word),
f AS (SELECT v.word, CASE WHEN -best[1] >= 5 * n THEN best[2] END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best[1] >= 5 * n THEN -best[1] END AS form_n FROM v LEFT JOIN t USING (word)),
w AS (SELECT word, word AS at, 0 AS hops FROM f UNION ALL SELECT w.word, f.form, hops + 1 FROM w JOIN f ON f.word = w.at WHERE f.form IS NOT NULL)
SELECT f.word, form, (SELECT max_by(w.at, w.hops) FROM w WHERE w.word = f.word) AS root, n, n_near, form_n::BIGINT AS form_n FROM f
"""

OP13_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS r FROM c),
x AS (SELECT *, 12 + 1 + 11 + length(r) + length(text) + len(regexp_extract_all(r, '<\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|\[\\*(INST\]|/INST\])'))
        + len(regexp_extract_all(text, '<\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|\[\\*(INST\]|/INST\])')) AS n FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""


def vocab(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_resolve_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_warc.revisit_report(op1_warc.archive_of_pages(table(spark, sf_dir, "pages")))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_html.extract(table(spark, sf_dir, "pages"))


def op3_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_quality.quality_report(table(spark, sf_dir, "documents"))


def op6_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_minhash.minhash_report(table(spark, sf_dir, "documents"))


def op7_dedup_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_substrings.dedup_substrings(table(spark, sf_dir, "documents"), digests=True)


def op8_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_lines.line_report(table(spark, sf_dir, "documents"))


def op9_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_token_counts.token_counts(table(spark, sf_dir, "documents"), vocab("byte_bpe_50k.json"))


def op10_sentencepiece_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_sentencepiece.encode(table(spark, sf_dir, "documents"), vocab("piece_bpe_32k.model"), outputs=("ids_sha256", "decoded_sha256"))


def op11_filter_audit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one more conversation, whose texts are made of control strings."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return op13_chat.chat_report(rows.unionByName(extra))


QUERIES = {f.__name__: f for f in (op1_resolve_revisits, op2_main_text, op3_embedding_near_dups, op4_mix_sources, op5_quality_rules, op6_minhash_near_dups, op7_dedup_substrings, op8_dedup_lines, op9_count_tokens, op10_sentencepiece_round, op11_filter_audit_orders, op12_spelling_variants, op13_chat_format)}
ORACLE_SQL = {"op1_resolve_revisits": OP1_SQL, "op2_main_text": OP2_SQL, "op3_embedding_near_dups": OP3_SQL, "op4_mix_sources": OP4_SQL, "op5_quality_rules": OP5_SQL, "op6_minhash_near_dups": OP6_SQL, "op7_dedup_substrings": OP7_SQL, "op8_dedup_lines": OP8_SQL, "op11_filter_audit_orders": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_chat_format": OP13_SQL}
