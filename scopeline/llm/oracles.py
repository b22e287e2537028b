"""DuckDB SQL for those queries that SQL can express over whole tables."""

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP7 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
runs AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c
  FROM (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d))),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM runs, (SELECT unnest(range(0, 5)) AS k) WHERE c >= 2 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines,
         (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper
  FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words
            OR 100 * n_symbols > 30 * n_words
            OR 100 * n_dup_lines > 30 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 100 * n_upper > 50 * word_chars) AS kept
FROM m
"""


def _shingles(table: str, key: str, lowered: str) -> str:
    """Distinct five-word shingles of a table's texts; shorter texts are one shingle."""
    return rf"""
  SELECT DISTINCT {key}, s FROM (
    SELECT {key}, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                              WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s
    FROM (SELECT {key}, {_WORDS.format(lowered)} AS ws FROM {table}))"""


OP2 = f"""
WITH d AS ({_shingles("documents", "doc_id", "lower(coalesce(text, ''))")}),
b AS ({_shingles("benchmark", "item_id", "lower(coalesce(text, ''))")}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT d.doc_id, b.item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY d.doc_id, b.item_id, n_item HAVING 100 * count(*) >= 75 * n_item
"""

#: A text as the template writes it: backslashes doubled, control strings broken after their first character.
_ESCAPED = r"regexp_replace(regexp_replace({}, '\\', '\\\\', 'g'), '(<)(/?s>|<SYS>>|</SYS>>)|(\[)(/?INST\]|/?ROLE\]|SAYS\])', '\1\3\\\2\4', 'g')"

OP3 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length({_ESCAPED.format("text")}) + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 17
             ELSE 23 + length({_ESCAPED.format("role")}) END AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH RECURSIVE s AS ({_shingles("documents", "doc_id", _LOW)}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM n UNION SELECT d, y FROM reach JOIN links ON x = r),
least AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least ON d = doc_id
"""

#: crc32 of an id as text, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
  lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda a, b: xor(a >> 1, 3988292384::UBIGINT * (a & 1::UBIGINT)))), 4294967295::UBIGINT)"""

#: Three-word histories' shorter forms as in the model: a pair of words is a history of its own from 200 occurrences on.
OP6 = f"""
WITH d AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append({_WORDS.format(_LOW)}, ' ') AS ws FROM documents),
t AS (SELECT doc_id, held_out, w, CASE WHEN i = 1 THEN '  ' ELSE ws[i - 1] END AS h, CASE WHEN i = 2 THEN '  ' WHEN i > 2 THEN ws[i - 2] END AS hh
      FROM (SELECT doc_id, held_out, ws, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d)),
u AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
s AS (SELECT w, c FROM u UNION ALL SELECT '  ', count(*) FROM d WHERE NOT held_out),
n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM u),
g AS (SELECT h, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY h, w),
q AS (SELECT hh, h, w, count(*) AS c FROM t WHERE NOT held_out AND hh IS NOT NULL GROUP BY hh, h, w),
p AS (SELECT doc_id, held_out, n, coalesce(u.c, 0) AS c, (coalesce(u.c, 0) + 1) / (n + v + 1) AS p, coalesce(g.c, 0) AS two, coalesce(s.c, 0) AS held,
             coalesce(q.c, 0) AS three, coalesce(k.c, 0) AS pair
      FROM t CROSS JOIN n LEFT JOIN u ON t.w = u.w LEFT JOIN g ON t.h = g.h AND t.w = g.w LEFT JOIN s ON t.h = s.w
      LEFT JOIN q ON t.hh = q.hh AND t.h = q.h AND t.w = q.w LEFT JOIN g k ON t.hh = k.h AND t.h = k.w),
r AS (SELECT doc_id, held_out, n, c, p, three, pair, (two + 50.0::DOUBLE * p) / (held + 50.0::DOUBLE) AS p2 FROM p)
SELECT doc_id, held_out, count(*) AS n_tokens, count_if(c > 0) AS n_known, n AS train_tokens, sum(log10(p)) AS base_score,
       sum(log10(CASE WHEN pair >= 200 THEN (three + 50.0::DOUBLE * p2) / (pair + 50.0::DOUBLE) ELSE p2 END)) AS score
FROM r GROUP BY doc_id, held_out, n
"""

OP10 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
b AS (SELECT doc_id, i, hex(h[i + 1:i + 1]) AS x, CASE WHEN i + 50 <= octet_length(h) THEN md5_number(h[i + 1:i + 50]) END AS s
      FROM (SELECT doc_id, h, unnest(range(0, octet_length(h))) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM b WHERE s IS NOT NULL GROUP BY s),
m AS (SELECT doc_id, i, x, coalesce(first < doc_id, FALSE)::INT AS hit FROM b LEFT JOIN f USING (s)),
c AS (SELECT doc_id, i, x, (coalesce(max(CASE WHEN hit = 1 THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -50) > i - 50)::INT AS gone FROM m),
e AS (SELECT doc_id, i, x, gone, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) AS prev FROM c),
g AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, sum((gone = 1 AND prev = 0)::INT)::BIGINT AS n_spans,
             string_agg(CASE WHEN gone = 0 THEN x END, '' ORDER BY i) AS kept
      FROM e GROUP BY doc_id)
SELECT d.doc_id, octet_length(h)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op2_decontamination": OP2,
    "op3_chat_tree": OP3,
    "op4_jaccard_tree": OP4,
    "op6_backoff_automaton": OP6,
    "op7_quality_rules": OP7,
    "op10_suffix_dedup": OP10,
}
