"""DuckDB SQL for the queries that SQL can express."""

OP3 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT rid, doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(t, '[\x09-\x0D\x20-\x40\x5B-\x60\x7B-\x7E]', '', 'g'))::BIGINT AS n_letters
  FROM d
), u AS (
  SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM m
), g AS (
  SELECT rid, i, word || ' ' || lead(word) OVER a || ' ' || lead(word, 2) OVER a AS win FROM u WINDOW a AS (PARTITION BY rid ORDER BY i)
), c AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, win) > 1 AND win IS NOT NULL AS twice FROM g
), r AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM c, (VALUES (0), (1), (2)) AS s(o) WHERE twice GROUP BY rid
), b AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, n_letters,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]')))::BIGINT AS n_bullet_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '([.][.][.]|\x{2026})[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines,
         len(list_intersect(w, ['the', 'of', 'and', 'to', 'in', 'is', 'der', 'die', 'und', 'das', 'ein', 'nicht', 'de', 'la', 'que', 'el', 'los', 'en', 'le', 'les', 'et', 'un', 'des', 'une']))::BIGINT AS n_stop_words
  FROM m LEFT JOIN r USING (rid)
), f AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
             + 8 * (word_chars < 3 * n_words)::BIGINT + 16 * (word_chars > 12 * n_words)::BIGINT + 32 * (2 * n_dup_lines > n_lines AND 10 * n_repeat_words > 3 * n_words)::BIGINT
             + 64 * (10 * n_letters < 7 * word_chars)::BIGINT + 128 * (10 * n_bullet_lines > 9 * n_lines)::BIGINT + 256 * (10 * n_ellipsis_lines > 3 * n_lines)::BIGINT
             + 512 * (n_stop_words < 2)::BIGINT)::BIGINT AS fail_bits
  FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_letters, n_bullet_lines, n_ellipsis_lines, n_stop_words,
       (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 63) = 0 AS kept, fail_bits = 0 AS kept_v2, fail_bits
FROM f
"""

OP4 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS did, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, doc_id, did, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), hot AS (
  SELECT key, max(did) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT did) >= 5
), r AS (
  SELECT rid, k.doc_id, line, pos, keeper IS NOT NULL AND k.did <> keeper AS gone FROM k LEFT JOIN hot USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY rid, doc_id
"""

OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d
), c AS (
  SELECT list_sort(s) AS k, min(doc_id) AS rep FROM s WHERE len(s) > 0 GROUP BY 1
), u AS (
  SELECT rep, unnest(k) AS g FROM c
), p AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS n FROM u a JOIN u b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN c x ON x.rep = a JOIN c y ON y.rep = b WHERE 100 * n >= 85 * (len(x.k) + len(y.k) - n)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r(v, to_v) AS (
  SELECT rep, rep FROM c UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.to_v
), m AS (
  SELECT v, min(to_v) AS comp FROM r GROUP BY v
)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, coalesce(comp, s.doc_id) AS component_id, s.doc_id = coalesce(comp, s.doc_id) AS kept
FROM s LEFT JOIN c ON list_sort(s.s) = c.k LEFT JOIN m ON m.v = c.rep
"""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents
), i AS (
  SELECT item_id, {WORDS} AS w FROM benchmark
), iw AS (
  SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda x: array_to_string(w[x:x + least(len(w), 10) - 1], ' '))) AS win FROM i WHERE len(w) > 0
), lens AS (
  SELECT DISTINCT n FROM iw
), dw AS (
  SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens)
), m AS (
  SELECT DISTINCT rid, dw.p, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n
), hit AS (
  SELECT rid, count(DISTINCT p + o)::BIGINT AS n_hit FROM (SELECT rid, p, unnest(range(0, n)) AS o FROM m) GROUP BY rid
), tc AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY word
), wl AS (
  SELECT DISTINCT item_id::VARCHAR AS item, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda x: w[x:x + least(len(w), 10) - 1])) AS win FROM i WHERE len(w) > 0
), ra AS (
  SELECT win, min(struct_pack(n := coalesce(n, 0), o := o, word := word)) AS r FROM (SELECT win, unnest(win) AS word, generate_subscripts(win, 1) AS o FROM (SELECT DISTINCT win FROM wl)) LEFT JOIN tc USING (word) GROUP BY win
), seat AS (
  SELECT rid, win, p FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) u JOIN ra ON u.word = r.word WHERE r.n > 0
), near AS (
  SELECT rid, count(DISTINCT item)::BIGINT AS n_near_items FROM seat JOIN d USING (rid) JOIN wl ON wl.win = seat.win WHERE list_has_all(d.w[greatest(p - 14, 1):p + 14], seat.win) GROUP BY rid
), its AS (
  SELECT rid, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM m) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
       coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid) LEFT JOIN near USING (rid)
"""

OP9 = r"""
WITH t AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT pair, turn, list_sort(list({'r': role, 'x': text}) FILTER (side = 'chosen')) AS a, list_sort(list({'r': role, 'x': text}) FILTER (side = 'rejected')) AS b FROM t GROUP BY pair, turn
), f AS (
  SELECT pair, min(turn) AS differs FROM k WHERE a IS DISTINCT FROM b GROUP BY pair
), m AS (
  SELECT t.*, differs IS NULL OR turn < differs AS agrees FROM t LEFT JOIN f USING (pair)
)
SELECT pair, CASE WHEN agrees THEN 'prompt' ELSE side END AS part, turn, coalesce(role, 'unknown') AS role,
       '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered, NOT agrees AND coalesce(role, 'unknown') = 'assistant' AS loss
FROM m WHERE NOT agrees OR side = 'chosen'
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_ledger": OP3, "op4_line_dedup": OP4, "op5_minhash_dedup": OP5, "op7_decontaminate": OP7, "op9_preference_format": OP9}
