"""DuckDB counterparts of the registered queries that SQL can express.

The other operators (spans with positions, token ids, archives, page trees, exact cuts, signatures) are tested against plain
Python instead.
"""

_QUALITY = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
a AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
e AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM a),
g AS (SELECT rid, pos, lead(word, 4) OVER o AS fifth,
  concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS win
  FROM e WINDOW o AS (PARTITION BY rid ORDER BY pos)),
r AS (SELECT rid, pos FROM g WHERE fifth IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
c AS (SELECT rid, count(DISTINCT pos + k) AS n FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY rid),
m AS (SELECT a.rid, doc_id, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM a LEFT JOIN c USING (rid)),
f AS (SELECT rid, source, unnest(['symbols', 'word_length', 'dup_lines']) AS rule,
  unnest([10 * n_symbols > n_words, word_chars < 2 * n_words OR word_chars > 15 * n_words, 10 * n_dup_lines > 3 * n_lines]) AS fails FROM m),
h AS (SELECT source, rule, count(*) AS docs, count(*) FILTER (fails) AS failures FROM f GROUP BY ALL),
p AS (SELECT rule, sum(failures) / sum(docs) AS mean, var_pop(failures / docs) AS spread FROM h GROUP BY rule),
s AS (SELECT rule, mean, greatest(1.0, least(1000.0, CASE WHEN spread > 0 THEN mean * (1 - mean) / spread - 1 ELSE 1000.0 END)) AS strength FROM p),
v AS (SELECT h.source, h.rule, (mean * strength + failures) / (strength + docs) AS rate FROM h JOIN s USING (rule)),
k AS (SELECT f.rid, coalesce(string_agg(rule, ',' ORDER BY rule = 'dup_lines', rule) FILTER (fails), '') AS host_fails,
  coalesce(string_agg(rule, ',' ORDER BY rule = 'dup_lines', rule) FILTER (rate > 0.5), '') AS host_condemned, bool_or(fails AND rate > 0.5) AS guilty,
  round(max(rate) FILTER (rule = 'symbols'), 6) AS rate_symbols, round(max(rate) FILTER (rule = 'word_length'), 6) AS rate_word_length,
  round(max(rate) FILTER (rule = 'dup_lines'), 6) AS rate_dup_lines
  FROM f JOIN v USING (rule) WHERE f.source IS NOT DISTINCT FROM v.source GROUP BY f.rid),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT guilty AS kept,
  host_fails, host_condemned, rate_symbols, rate_word_length, rate_dup_lines FROM b JOIN k USING (rid)
"""

_JOIN = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
e AS (SELECT rid, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM t),
g AS (SELECT rid, n, pos, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS shingle
  FROM e WINDOW o AS (PARTITION BY rid ORDER BY pos)),
s AS (SELECT DISTINCT rid, shingle FROM g WHERE pos <= greatest(n - 4, 1)),
z AS (SELECT rid, count(*) AS size FROM s GROUP BY rid),
o AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN z x ON x.rid = a JOIN z y ON y.rid = b WHERE 100 * shared >= 75 * (x.size + y.size - shared)),
q AS (SELECT rid AS a, rid AS b FROM t UNION SELECT q.a, l.b FROM q JOIN l ON l.a = q.b)
SELECT t.doc_id, coalesce(z.size, 0)::BIGINT AS n_shingles,
  (SELECT min(u.doc_id) FROM q JOIN t u ON u.rid = q.b WHERE q.a = t.rid) AS component_id,
  (SELECT count(*) FROM l WHERE l.a = t.rid)::BIGINT AS n_links
FROM t LEFT JOIN z USING (rid)
"""

_CHAT = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 24)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_PHRASES = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS rid,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, rid, unnest(p) AS piece, generate_subscripts(p, 1) AS pid FROM (SELECT *, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS p FROM t)),
w AS (SELECT lang, rid, pid, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
o AS (SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda x: array_to_string(list_slice(words, x, x + k - 1), ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM o GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
s AS (SELECT *, string_split(phrase, ' ') AS v FROM f WHERE k > 1),
i AS (SELECT DISTINCT lang, a, array_to_string(list_slice(v, x, x + y - 1), ' ') AS phrase FROM s, range(1, 4) AS q(x), range(2, 4) AS z(y) WHERE y < k AND x + y - 1 <= k),
d AS (SELECT lang, phrase, max(a) AS b FROM i GROUP BY ALL),
c AS (SELECT s.* FROM s LEFT JOIN d USING (lang, phrase) WHERE b IS NULL OR 100 * b < 80 * a),
z AS (SELECT c.*, j, array_to_string(list_slice(v, 1, j), ' ') AS head, array_to_string(list_slice(v, j + 1, k), ' ') AS rest FROM c, range(1, 4) AS q(j) WHERE j < k),
u AS (SELECT z.lang, z.phrase, z.a, j, x.a AS l, y.a AS r, 2000000 * z.a // (x.a + y.a) AS score FROM z
  JOIN f x ON x.lang = z.lang AND x.phrase = head JOIN f y ON y.lang = z.lang AND y.phrase = rest),
m AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase))::BIGINT AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM m JOIN n USING (lang) QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op2_ngram_join": _JOIN,
    "op6_host_quality": _QUALITY,
    "op9_chat_tokens": _CHAT,
    "op11_phrase_collocations": _PHRASES,
}
