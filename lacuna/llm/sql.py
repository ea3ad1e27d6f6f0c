"""SQL that states the results of the operators that SQL can express."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII string, bit by bit."""
    codes = f"list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT))"
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce({codes}, lambda c, b: {byte}), 4294967295)"


WORD = r"[^\x20\x09-\x0D]"

PREFIX_TRIE = rf"""
WITH turns AS (
    SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, len(regexp_extract_all(coalesce(text, ''), '{WORD}+')) AS words,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS k
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, conv_id - conv_id % 20 AS head, {crc32("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
    SELECT c.conv_id, t.key, t.words, t.k AS place FROM convs c JOIN turns t ON t.conv_id = c.head AND t.k <= c.h
    UNION ALL
    SELECT c.conv_id, t.key, t.words, t.k + 1000000000 FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h
), paths AS (
    SELECT conv_id, words, row_number() OVER w AS depth, string_agg(key, '') OVER w AS path, length(string_agg(key, '') OVER w) AS n FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY place)
    UNION ALL
    SELECT conv_id, 0, 0, '', 0 FROM convs
), members AS (
    SELECT *, CASE WHEN depth > 0 THEN path[:n - 64] END AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM paths
), nodes AS (
    SELECT path, parent, depth, words, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
    FROM members GROUP BY path, parent, depth, words
), kids AS (SELECT parent AS path, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path)
), subtrees AS (
    SELECT m.path, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
    FROM full_nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.path
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN subtrees s USING (path) LEFT JOIN nodes p ON p.path = n.parent
"""

CONVERSATION_REPAIR = rf"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), hit AS (SELECT *, {crc32("key")} % 20 AS fault FROM keyed
), damaged AS (
    SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        row_number() OVER () AS rid
    FROM hit, unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copies(copy)
), numbered AS (
    SELECT *, row_number() OVER w AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, rid) > 1 AS seen, role[1:1] AS initial, lag(role[1:1]) OVER w AS before
    FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), rid)
), faulty AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '{WORD}') THEN 'b' WHEN seen THEN 'd' WHEN regexp_extract(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '(?s).$') NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault
    FROM numbered
), counted AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id
), starts AS (  -- the best edits after `at` rows that end in each state: nothing yet, after system, after user, after assistant
    SELECT conv_id, 0::BIGINT AS pos, struct_pack(c := 0, a := '') AS s0, struct_pack(c := 1000000, a := '') AS s1, struct_pack(c := 1000000, a := '') AS s2, struct_pack(c := 1000000, a := '') AS s3 FROM counted
), steps AS (
    SELECT * FROM starts
    UNION ALL
    SELECT conv_id, pos, struct_pack(c := s0.c + 3, a := s0.a || 'D'),
        least(struct_pack(c := s1.c + 3, a := s1.a || 'D'), struct_pack(c := s0.c + cut + CASE WHEN keep AND initial = 's' THEN 0 ELSE 1000000 END, a := s0.a || 'K')),
        least(struct_pack(c := i2.c + 3, a := i2.a || 'D'), struct_pack(c := user_.c + cut + CASE WHEN keep AND initial = 'u' THEN 0 ELSE 1000000 END, a := user_.a || 'K'), struct_pack(c := user_.c + cut + CASE WHEN keep THEN 2 ELSE 1000000 END, a := user_.a || 'R')),
        least(struct_pack(c := i3.c + 3, a := i3.a || 'D'), struct_pack(c := i2.c + cut + CASE WHEN keep AND initial = 'a' THEN 0 ELSE 1000000 END, a := i2.a || 'K'), struct_pack(c := i2.c + cut + CASE WHEN keep THEN 2 ELSE 1000000 END, a := i2.a || 'R'))
    FROM (
        SELECT *, least(s0, s1, i3) AS user_ FROM (
            SELECT *, least(s3, struct_pack(c := i2.c + 2, a := i2.a || 'I')) AS i3 FROM (
                SELECT f.conv_id, f.pos, s0, s1, s2, s3, f.initial, f.fault NOT IN ('b', 'd') AS keep, (f.fault = 't')::INTEGER AS cut,
                    least(s2, struct_pack(c := s0.c + 2, a := s0.a || 'I'), struct_pack(c := s1.c + 2, a := s1.a || 'I'), struct_pack(c := s3.c + 2, a := s3.a || 'I')) AS i2
                FROM steps s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.pos = s.pos + 1
            )
        )
    )
), best AS (
    SELECT s.conv_id, least(s0, s3, struct_pack(c := s2.c + 2, a := s2.a || 'I'), struct_pack(c := s0.c + 4, a := s0.a || 'II'), struct_pack(c := s1.c + 4, a := s1.a || 'II')) AS b
    FROM steps s JOIN counted c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.pos
), edits AS (
    SELECT conv_id, k, b.a[k] AS edit, length(regexp_replace(b.a[:k], 'I', '', 'g')) AS pos FROM best, unnest(range(1, length(b.a) + 1)) AS t(k)
), placed AS (
    SELECT e.conv_id, e.k, e.edit, f.role, f.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.k) AS place
    FROM edits e LEFT JOIN faulty f ON e.edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.pos = e.pos WHERE e.edit <> 'D'
), led AS (
    SELECT *, max((place = 1 AND edit = 'K' AND role[1:1] = 's')::INTEGER) OVER (PARTITION BY conv_id) AS lead FROM placed
), repaired AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS whole FROM led GROUP BY conv_id
)
SELECT i.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
    coalesce(b.b.c, 0)::BIGINT AS cost, coalesce(b.b.a, '') AS audit, sha256(coalesce(r.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM i.conv_id
"""
