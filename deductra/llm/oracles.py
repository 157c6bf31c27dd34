"""SQL for the corpus queries that DuckDB can judge over whole tables: op4, op5, op8, op10."""

#: A conversation's turns with the added one, and the marks' lengths; a text with a control string gets one backslash for each.
OP4 = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
made AS (SELECT *, length(text) + len(regexp_extract_all(text, '\[\\*(INST|/INST|ROLE|SEP|/ROLE|ESC)\]|<\\*/s>')) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 ELSE 18 + length(role) END AS chars FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM made GROUP BY conv_id
"""

#: Strings of 100 bytes by place; those that start earlier too, the bytes that they cover, and what is left.
OP5 = """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
bytes AS (SELECT doc_id, unnest(range(1, octet_length(b) + 1)) AS i, b FROM docs),
starts AS (SELECT doc_id, i, md5_number(b[i : i + 99]) AS w FROM bytes WHERE i + 99 <= octet_length(b)),
later AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS again FROM starts),
marked AS (SELECT x.doc_id, x.i, hex(x.b[x.i : x.i]) AS byte, coalesce(l.again, false) AS again FROM bytes x LEFT JOIN later l ON l.doc_id = x.doc_id AND l.i = x.i),
gone AS (SELECT doc_id, i, byte, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM marked),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM gone),
found AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM edges GROUP BY doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs d LEFT JOIN found f ON f.doc_id = d.doc_id
"""

#: Windows of 35 words that start twice or more, the words that they cover, and what is left.
OP8 = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM docs),
starts AS (SELECT doc_id, i, md5_number(array_to_string(ws[i : i + 34], ' ')) AS w FROM words WHERE i + 34 <= len(ws)),
many AS (SELECT doc_id, i, count(*) OVER (PARTITION BY w) > 1 AS again FROM starts),
marked AS (SELECT w.doc_id, w.i, w.ws[w.i] AS word, coalesce(m.again, false) AS again FROM words w LEFT JOIN many m ON m.doc_id = w.doc_id AND m.i = w.i),
gone AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM marked),
found AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs d LEFT JOIN found f ON f.doc_id = d.doc_id
"""

#: All pairs that share a shingle, the links among them, and the least document that each reaches.
OP10 = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, md5_number(array_to_string(ws[i : i + 3], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM docs WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
least AS (SELECT u, min(v) AS v FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.v, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.v, d.doc_id) AS kept
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.u = d.doc_id
"""

SQL = {"op4_chat": OP4, "op5_suffix_array_dedup": OP5, "op8_substring_dedup": OP8, "op10_minhash": OP10}
