"""SQL for the queries that SQL can express, over the same tables."""
from __future__ import annotations

import re

from .chat import CONTROL, END, TEXT, TURN

_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM k),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) z GROUP BY 1),
f AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
  length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS n_letters, len(regexp_extract_all(t, '!!')) AS n_exclaimed, len(list_distinct(w)) AS n_distinct FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 2 * n_upper > n_letters OR 5 * n_exclaimed > n_words OR NOT (2 * n_words <= word_chars AND word_chars <= 25 * n_words)
    OR (n_words <= 1000 AND 5 * n_distinct < n_words)) AS kept FROM b"""

_ESCAPED = "len(regexp_extract_all({0}, '" + "|".join(["\\\\", *(re.escape(c).replace("'", "''") for c in CONTROL)]) + "'))"
CHATS = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum({len(TURN + TEXT + END)} + length(role) + length(text) + {_ESCAPED.format('role')} + {_ESCAPED.format('text')}) AS formatted_chars FROM c GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, cast(formatted_chars AS bigint) AS formatted_chars FROM g"""

LEAKS = f"""
WITH i AS (SELECT cast(item_id AS varchar) AS item, {_WORDS.format('text')} AS w FROM benchmark),
v AS (SELECT item, len(w) AS n, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(n, 10) AS size, array_to_string(w[k : k + least(n, 10) - 1], ' ') AS s FROM v),
sizes AS (SELECT DISTINCT size FROM win),
d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
p AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size),
h AS (SELECT doc_id, k, win.size, item FROM (SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS s FROM p) q JOIN win USING (size, s)),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM (SELECT DISTINCT doc_id, k, size FROM h) u) z GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) z GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

SIMILAR = f"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS t, min(doc_id) AS rep FROM documents GROUP BY 1),
w AS (SELECT rep, {_WORDS.format('t')} AS w FROM t),
s AS (SELECT DISTINCT rep, s FROM (SELECT rep, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0) x) y),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.rep AS a, y.rep AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.rep < y.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN n na ON na.rep = a JOIN n nb ON nb.rep = b WHERE 5 * shared >= 4 * (na.n + nb.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT rep AS a, rep AS b FROM t UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b)
SELECT doc_id, (SELECT min(c.b) FROM c WHERE c.a = t.rep) AS class_id, t.rep AS copy_of, (SELECT count(*) FROM e WHERE e.a = t.rep) AS n_links FROM documents d JOIN t ON t.t = coalesce(d.text, '')"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(1, length(x) // 2 - 98)) AS k FROM d WHERE length(x) >= 200),
w AS (SELECT doc_id, k, substring(x, 2 * k - 1, 200) AS s FROM p),
r AS (SELECT doc_id, k FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, k) > 1),
g AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 100 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT doc_id, min(k) AS a, max(k) + 100 AS b FROM (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM g) z GROUP BY doc_id, run),
j AS (SELECT doc_id, a, b, lag(b, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM i),
m AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substring(x, 2 * before - 1, 2 * (a - before)), '' ORDER BY a) AS head FROM j JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, length(x) // 2 AS n_bytes, cast(coalesce(n_removed, 0) AS bigint) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN last IS NULL THEN x ELSE concat(head, substring(x, 2 * last - 1)) END)) AS kept_sha256 FROM d LEFT JOIN m USING (doc_id)"""

FILTERS = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT t, min(doc_id) AS least FROM d GROUP BY 1),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
  + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int AS mask
  FROM d JOIN m USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY 1, 2),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS z, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT concat(a.z, b.z, c.z, d.z, e.z) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM k a, k b, k c, k d, k e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::int AS gone FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) z),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (gone | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & gone = 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & bit > 0 AND mask & gone > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
  coalesce(sum(g) FILTER (mask & bit > 0 AND mask & gone = 0), 0) AS good_lost, coalesce(sum(x) FILTER (mask & bit > 0 AND mask & gone = 0), 0) AS toxic_lost FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails, good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::bigint AS shapley FROM r"""

NEAR = f"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS t, min(doc_id) AS rep FROM documents GROUP BY 1),
w AS (SELECT rep, regexp_extract_all({_LOW.format('t')}, '[^\\x20\\x09-\\x0D]+') AS w FROM t),
s AS (SELECT DISTINCT rep, s FROM (SELECT rep, array_to_string(w[k : k + 3], ' ') AS s FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM w WHERE len(w) > 0) x) y),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.rep AS a, y.rep AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.rep < y.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN n na ON na.rep = a JOIN n nb ON nb.rep = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT rep AS a, rep AS b FROM n UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b),
g AS (SELECT a, min(b) AS least FROM c GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(g.least, doc_id) AS component_id, coalesce(g.least, doc_id) = doc_id AS kept
FROM documents d JOIN t ON t.t = coalesce(d.text, '') LEFT JOIN n USING (rep) LEFT JOIN g ON g.a = t.rep"""

REPAIR = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')) AS name FROM conversations),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(name, ''), lambda x: ascii(x)::bigint)),
  lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295::bigint) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM h WHERE kind <> 0) z),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM d),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM p),
r AS (SELECT conv_id, turn, i, role, text, role[1] AS z, blank OR again AS gone, (NOT blank AND NOT again AND cut)::int AS cut, blank, again AND NOT blank AS again,
  coalesce(concat(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i), role[1]) NOT IN ('su', 'ua', 'au') AND i > 1, false) AS illegal FROM f),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, sum(cut)::bigint AS truncated, count(*) FILTER (illegal) AS illegal, max(i) AS n FROM r GROUP BY 1),
ins AS (SELECT unnest([0, 1, 2, 3, 0, 1, 2, 3, 0, 1, 2, 3]) AS q, unnest([0, 1, 2, 3, 2, 2, 3, 2, 3, 3, 2, 3]) AS w, unnest([0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2]) AS m),
edit AS (SELECT unnest(['K', 'R', 'D']) AS e),
made AS (SELECT q, w, m, CASE m WHEN 0 THEN '' WHEN 1 THEN CASE q WHEN 2 THEN concat('assistant:', chr(10)) ELSE concat('user:', chr(10)) END ELSE CASE q WHEN 2 THEN concat('assistant:', chr(10), 'user:', chr(10)) ELSE concat('user:', chr(10), 'assistant:', chr(10)) END END AS said FROM ins),
s AS (SELECT conv_id, 0::bigint AS i, 0 AS q, {'cost': 0::bigint, 'audit': '', 'said': ''} AS b FROM c
  UNION ALL
  SELECT conv_id, i, q, min(b) AS b FROM (
    SELECT s.conv_id, r.i, CASE e WHEN 'D' THEN w WHEN 'R' THEN CASE w WHEN 2 THEN 3 ELSE 2 END ELSE CASE z WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS q,
      {'cost': b.cost + 2 * m + CASE e WHEN 'D' THEN 3 WHEN 'R' THEN 2 + cut ELSE cut END, 'audit': concat(b.audit, repeat('I', m), e),
       'said': concat(b.said, made.said, CASE e WHEN 'D' THEN '' WHEN 'R' THEN concat(CASE w WHEN 2 THEN 'assistant:' ELSE 'user:' END, text, chr(10)) ELSE concat(role, ':', text, chr(10)) END)} AS b
    FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1 JOIN made ON made.q = s.q CROSS JOIN edit
    WHERE e = 'D' OR NOT gone AND (e = 'R' OR z = 's' AND w = 0 OR z = 'u' AND w <> 2 OR z = 'a' AND w = 2)) x GROUP BY 1, 2, 3),
done AS (SELECT s.conv_id, min({'cost': b.cost + 2 * m, 'audit': concat(b.audit, repeat('I', m)), 'said': concat(b.said, made.said)}) AS b FROM s JOIN c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.i JOIN made ON made.q = s.q WHERE w IN (0, 3) GROUP BY 1),
o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit,
  sha256(coalesce(b.said[: -2], '')) AS repaired_sha256 FROM o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id"""
