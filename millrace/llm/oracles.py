"""DuckDB SQL for the queries that SQL can express."""

WS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP3 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), told AS (
  SELECT *,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]')) AS chars,
    length(role) + length(role) - length(replace(role, '\', '')) + len(regexp_extract_all(role, '</?s>|\[/?INST\]')) + 13 AS head
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(chars + CASE WHEN before IS NULL THEN head WHEN before = role THEN 3 ELSE head + 4 END) + 4)::BIGINT AS formatted_chars
FROM told GROUP BY conv_id
"""

OP6 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL
), links AS (SELECT x, y FROM pairs WHERE 100 * c >= 90 * (nx + ny - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
least_of AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id
FROM sets s LEFT JOIN least_of ON s.doc_id = x
"""

OP10 = rf"""
WITH lines AS (
  SELECT doc_id, line, pos, translate(trim(line, {WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), frequent AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.*, f.k IS NOT NULL AS gone FROM lines l LEFT JOIN frequent f ON l.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP11 = r"""
WITH RECURSIVE bits(n, r, k) AS (
  SELECT n, n, 0 FROM range(256) t(n)
  UNION ALL SELECT n, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(r ORDER BY n) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, w, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY ALL
), hashed AS (
  SELECT w, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END)), lambda x: x::BIGINT)),
    lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) AS h
  FROM runs, crc
), damaged AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, c FROM hashed
), words AS (SELECT word, sum(c)::BIGINT AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cut AS (SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS v, substr(word, 1, i) || '*' || substr(word, i + 2) AS o FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word AS w, b.word AS x, b.n AS n FROM (SELECT DISTINCT word, o FROM cut) a JOIN (SELECT DISTINCT word, n, o FROM cut) b ON a.o = b.o AND a.word <> b.word
  UNION SELECT DISTINCT c.word, b.word, b.n FROM cut c JOIN words b ON c.v = b.word
  UNION SELECT DISTINCT b.word, c.word, c.n FROM cut c JOIN words b ON c.v = b.word
), best AS (SELECT w, count(*)::BIGINT AS n_near, max(n) AS top FROM near GROUP BY w),
first_of AS (SELECT near.w, min(x) AS x FROM near JOIN best ON near.w = best.w AND near.n = best.top GROUP BY near.w),
formed AS (
  SELECT word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 5 * words.n THEN x END AS form, CASE WHEN top >= 5 * words.n THEN top END::BIGINT AS form_n
  FROM words LEFT JOIN best ON best.w = word LEFT JOIN first_of ON first_of.w = word
), walk(word, root, k) AS (SELECT word, word, 0 FROM formed UNION ALL SELECT walk.word, f.form, k + 1 FROM walk JOIN formed f ON walk.root = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, max_by(root, k) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": OP3, "op6_ngram_jaccard": OP6, "op10_line_dedup": OP10, "op11_spelling": OP11}
