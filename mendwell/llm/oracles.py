"""DuckDB SQL that gives the rows of a query, where SQL can."""

from __future__ import annotations

_DEDUP = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""

_ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    "|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
)
_KINDS = (
    ("assign", _ASSIGN, 6, 2), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0),
    ("github", "gh[opsur]_[A-Za-z0-9]+", 40, 0), ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0),
)


def _spans_sql(place: int, kind: str, pattern: str, least: int, group: int) -> str:
    return f"""
  SELECT row, {place} AS place, '{kind}' AS kind, start, start + length(m) AS stop FROM (
    SELECT row, m, c, sum(length(b) + length(m)) OVER (PARTITION BY row ORDER BY i) - length(m) AS start FROM (
      SELECT row, unnest(bs[:len(ms)]) AS b, unnest(ms) AS m, unnest(cs) AS c, generate_subscripts(ms, 1) AS i FROM (
        SELECT row, string_split_regex(body, '{pattern}') AS bs, regexp_extract_all(body, '{pattern}') AS ms,
               regexp_extract_all(body, '{pattern}', {group}) AS cs FROM t)))
  WHERE length(c) >= {least}"""


_SECRETS = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body FROM documents),
s AS ({" UNION ALL ".join(_spans_sql(i, *kind) for i, kind in enumerate(_KINDS))}),
g AS (SELECT row,
        count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
      FROM s GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (row)
"""

_MIX = r"""
WITH q AS (SELECT doc_id, avg(CASE WHEN quality > 0 THEN 2.0::DOUBLE WHEN quality = 0 THEN 0.5 ELSE 1 END) AS weight
           FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE)
            / 4503599627370496) / coalesce(weight, 1) AS draw
      FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
      FROM s),
-- those that fill up are the first ones by size a weight; the level is that of the first one that does not
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0))
                / sum(w) OVER rest AS level FROM r
      WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             rest AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (SELECT first(level ORDER BY source_size / w, source NULLS LAST) FILTER (w * level <= 2 * source_size) AS level FROM l),
t AS (SELECT source, source_size, least(2.0 * source_size, w * v.level)::DOUBLE AS target FROM r, v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
p AS (SELECT doc_id, size, source_size, target, epochs, sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id) - size AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN before + size / 2.0 <= target - epochs * source_size AND target > epochs * source_size
                              THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""

_PHRASES = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
o AS (SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
      UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
      UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
f AS (SELECT lang, k, phrase, count(*) AS a FROM o GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
h AS (SELECT lang, part, max(a) AS longer
      FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS part FROM c WHERE k = 3) GROUP BY lang, part),
u AS (SELECT lang, phrase, a, 1 AS cut, ws[1] AS head, phrase[length(ws[1]) + 2:] AS tail FROM c
      UNION ALL SELECT lang, phrase, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM c WHERE k = 3),
s AS (SELECT u.lang, u.phrase, u.a, cut, l.a AS l, r.a AS r, (1000000::HUGEINT * u.a * u.a // (l.a::HUGEINT * r.a)) AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.head JOIN f r ON r.lang = u.lang AND r.phrase = u.tail),
b AS (SELECT s.*, h.longer FROM s LEFT JOIN h ON h.lang = s.lang AND h.part = s.phrase
      QUALIFY row_number() OVER (PARTITION BY s.lang, s.phrase ORDER BY score, cut) = 1),
k AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score::BIGINT AS score
      FROM b WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT k.lang, rank, phrase, a, l, r, n, score FROM k JOIN n ON n.lang = k.lang WHERE rank <= 2000
"""

# CRC-32 of decimal ids, byte by byte with a table of 256 remainders
_REBUILT = """
z AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS z),
o AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, sha256(
        strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS ts
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, ts, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
        lambda x, b: xor(z[(xor(x, b) & 255) + 1], x >> 8)), 4294967295) % 6 AS h FROM o, z),
b AS (SELECT h.conv_id, list_concat(coalesce(o.ts[:h], []), h.ts[h + 1:]) AS ts FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 100)
"""

_TRIE = f"""
WITH {_REBUILT},
m AS (SELECT conv_id, unnest(range(len(ts) + 1)) AS depth, len(ts) AS n, list_transform(ts, lambda t: t.role || chr(1) || t.text) AS path, ts FROM b),
g AS (SELECT path[:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(length(ts[depth].text)), 0) AS size,
             coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends
      FROM m GROUP BY path[:depth], depth),
c AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY path[:depth - 1]),
l AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN c USING (path)),
s AS (SELECT path[:d] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens
      FROM (SELECT path, n_children, n_convs, size, unnest(range(depth + 1)) AS d FROM l) GROUP BY path[:d])
SELECT l.conv_id, l.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, l.n_convs, l.n_children, n_leaves, saved_tokens, sha256(l.ends) AS ends_sha256
FROM l JOIN s USING (path) LEFT JOIN g p ON l.depth > 0 AND p.path = l.path[:l.depth - 1]
"""

_CHAT = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS g, row_number() OVER v AS i, conv_id, role, text,
        coalesce(floor(turn / 1024)::BIGINT, -4611686018427387904) AS chapter,
        24 + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS chars,
        4 + len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D\x20]')) AS tokens
      FROM c WINDOW v AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text))),
s AS (SELECT g, tokens AS sys_tokens, chars AS sys_chars, chapter AS sys_chapter FROM t WHERE i = 1 AND role = 'system'),
u AS (SELECT t.g, row_number() OVER w AS j, tokens, chars, chapter, dense_rank() OVER (PARTITION BY t.g ORDER BY chapter) AS place,
        coalesce(sys_tokens, 0) AS sys_tokens, coalesce(sys_chars, 0) AS sys_chars, chapter <> sys_chapter AS alone, sum(tokens) OVER w AS upto
      FROM t LEFT JOIN s ON s.g = t.g WHERE NOT (i = 1 AND sys_tokens IS NOT NULL) WINDOW w AS (PARTITION BY t.g ORDER BY i)),
-- what a window that begins with turn j repeats
b AS (SELECT u.g, u.j, u.tokens, u.place, u.sys_tokens, u.sys_chars, u.alone, coalesce(sum(p.tokens), 0) AS old_tokens, coalesce(sum(p.chars), 0) AS old_chars
      FROM u LEFT JOIN u p ON p.g = u.g AND p.j < u.j AND p.j >= u.j - 4 AND p.place >= u.place - 1
        AND u.upto - u.tokens - (p.upto - p.tokens) <= 256 AND u.upto - (p.upto - p.tokens) <= 1024 - u.sys_tokens
      GROUP BY ALL),
w AS (SELECT g, j, place, sys_tokens + tokens AS used, CASE WHEN alone THEN sys_chars ELSE 0 END::HUGEINT AS again FROM b WHERE j = 1
      UNION ALL
      SELECT b.g, b.j, b.place, CASE WHEN w.place = b.place AND used + tokens <= 1024 THEN used + tokens ELSE sys_tokens + old_tokens + tokens END,
             CASE WHEN w.place = b.place AND used + tokens <= 1024 THEN 0 ELSE sys_chars + old_chars END
      FROM w JOIN b ON b.g = w.g AND b.j = w.j + 1),
a AS (SELECT g, sum(again) AS again FROM w GROUP BY g)
SELECT any_value(conv_id) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(chars) + coalesce(any_value(again), 0))::BIGINT AS formatted_chars
FROM t LEFT JOIN a ON a.g = t.g GROUP BY t.g
"""

ORACLES = {
    "op1_exact_dedup": _DEDUP,
    "op6_secret_scan": _SECRETS,
    "op7_mixing": _MIX,
    "op11_prefix_trie": _TRIE,
    "op12_chat_windows": _CHAT,
    "op13_phrases": _PHRASES,
}
