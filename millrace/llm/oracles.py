"""DuckDB equivalents of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from millrace.llm.quality import BOILERPLATE

_GAP = r"[\x20\x09-\x0D]+"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_GAP}'), lambda w: w <> '')"


def _count(x: str) -> str:
    return f"len({_words(x)})"


def _without(x: str, chars: str) -> str:
    return f"(length({x}) - length(translate({x}, '{chars}', '')))"


def _matched(x: str, pattern: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '{pattern}', '', 'g')))"


_PHRASES = "[" + ", ".join(f"'{p}'" for p in BOILERPLATE) + "]"

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_words('t')} AS w, list_filter(string_split(t, chr(10)), lambda l: trim(l, {_BLANKS}) <> '') AS ls FROM d),
win AS (SELECT doc_id, i, hash(w[i], w[i + 1], w[i + 2]) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) FROM rep) GROUP BY 1),
ln AS (SELECT doc_id, l, {_count('l')} AS n FROM (SELECT doc_id, unnest(ls) AS l FROM w)),
bad AS (SELECT doc_id, sum(n) AS lost FROM ln WHERE
    ({_without('l', '|»›•')} > 0 AND {_without('l', '|»›•')} * 4 >= n)
    OR ({_without('l', '#*$%&|<>')} > 0 AND {_without('l', '#*$%&|<>')} * 4 >= n)
    OR ({_matched('l', chr(92) + 'p{Lu}+')} >= 20 AND {_matched('l', chr(92) + 'p{Lu}+')} > {_matched('l', chr(92) + 'p{Ll}+')})
    OR (n >= 3 AND NOT regexp_matches(l, '[.!?…。！？:;]'))
    OR (n <= 25 AND len(list_filter({_PHRASES}, lambda p: contains(lower(l), p))) > 0) GROUP BY 1),
r AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    {_without('t', '#*$%&|<>')}::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
    FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN bad USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (lost * 100 > n_words * 50) AS kept FROM r
"""

_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUNS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
WITH b AS (SELECT item_id, regexp_extract_all({_FOLDED}, '{_RUNS}') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + 9], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all({_FOLDED}, '{_RUNS}'), []) AS w FROM documents),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS k FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM iw))),
h AS (SELECT doc_id, size, i, item_id FROM dw JOIN iw USING (size, k)),
p AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

LINE_DEDUP = f"""
WITH l0 AS (SELECT doc_id, j, line, trim(line, {_BLANKS}) AS bare FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM documents)),
l AS (SELECT *, {_count('bare')} AS n FROM l0),
q AS (SELECT *, sum(CASE WHEN bare <> '' AND j > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY j) AS pl FROM l),
s AS (SELECT doc_id, list(bare ORDER BY j) AS ls, list(n ORDER BY j) AS ws, min(pl) AS base FROM q WHERE bare <> '' GROUP BY 1),
w AS (SELECT doc_id, base, a, n, list_sum(ws[a:a + n - 1]) AS total, ws[a] AS head, ws[a + n - 1] AS tail, array_to_string(ls[a:a + n - 1], chr(10)) AS k
    FROM (SELECT *, unnest(range(1, least(6, len(ls) - a + 1) + 1)) AS n FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS a FROM s))),
m AS (SELECT doc_id, base, a, n, row_number() OVER (PARTITION BY k ORDER BY doc_id, a) AS seen FROM w WHERE total >= 6 AND (total - tail < 6 OR total - head < 6)),
g AS (SELECT DISTINCT doc_id, (base + unnest(range(a - 1, a + n - 1)))::BIGINT AS pl FROM m WHERE seen > 1),
r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (before IS NULL OR before <> pl - 1) AS runs FROM (SELECT *, lag(pl) OVER (PARTITION BY doc_id ORDER BY pl) AS before FROM g) GROUP BY 1),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY j) AS kept FROM q WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = q.doc_id AND g.pl = q.pl) GROUP BY 1)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_removed, coalesce(r.runs, 0)::BIGINT AS n_runs, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LABELS = "l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1)"

FILTER_AUDIT = f"""
WITH {_LABELS},
d0 AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
d1 AS (SELECT *, {_words('t')} AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d0),
d AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * {_without('t', _CAPITALS)} > 3 * length(t), regexp_matches(t, '[#$%&*|]'), least IS NOT NULL AND (d1.doc_id IS NULL OR d1.doc_id > least)] AS f,
    coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM d1 LEFT JOIN l ON l.doc_id = d1.doc_id),
c AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY 1, 2),
e AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM e a, e b, e c, e d, e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS filter, string_split(filter_order[1:step - 1], '') AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, filter, n, good, toxic, f[ascii(filter) - 64] AS fails, len(list_filter(before, lambda y: y <> '' AND f[ascii(y) - 64])) > 0 AS gone, len(list_filter(f, lambda y: y)) = 1 AS alone FROM c, s),
q AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM q
"""

_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
#: CRC-32 of the decimal digits of x, bit by bit.
_CRC = (
    "xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(x::VARCHAR, ''), lambda y: ascii(y)::BIGINT)), "
    f"lambda s, y: list_reduce(list_concat([xor(s, y)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: {_CRC_STEP})))"
)

CONVERSATION_TRIE = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY i) AS ts FROM t GROUP BY 1),
h AS (SELECT conv_id, ts, conv_id - conv_id % 100 AS base, {_CRC.replace('x::VARCHAR', 'conv_id::VARCHAR')} % 6 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN o b ON b.conv_id = h.base),
p AS (SELECT conv_id, len(ts) AS size, d, ts[1:d] AS k, CASE WHEN d > 0 THEN length(ts[d].text) ELSE 0 END AS chars FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM r)),
g AS (SELECT d, md5(k::VARCHAR) AS k, any_value(k) AS whole, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '') AS ends FROM p GROUP BY 1, 2),
u AS (SELECT g.*, CASE WHEN d > 0 THEN md5(whole[1:d - 1]::VARCHAR) END AS pk FROM g),
c AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM u WHERE d > 0 GROUP BY 1, 2),
a AS (SELECT x.d, x.k, (x.n - 1) * x.chars AS saved, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(0, x.d + 1)) AS up_to, whole FROM u x LEFT JOIN c ON c.d = x.d AND c.k = x.k),
s AS (SELECT up_to AS d, md5(whole[1:up_to]::VARCHAR) AS k, sum(saved)::BIGINT AS saved, sum(leaf)::BIGINT AS leaves FROM a GROUP BY 1, 2)
SELECT u.conv_id, u.d::BIGINT AS depth, up.conv_id AS parent_conv_id, u.n AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, sha256(u.ends) AS ends_sha256
FROM u LEFT JOIN u up ON up.d = u.d - 1 AND up.k = u.pk LEFT JOIN c ON c.d = u.d AND c.k = u.k JOIN s ON s.d = u.d AND s.k = u.k
"""

SOURCE_MIX = f"""
WITH {_LABELS},
d AS (SELECT d.doc_id, source, {_count("coalesce(text, '')")}::BIGINT AS size, md5(coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS m,
    CASE WHEN quality = 1 THEN 1.0 WHEN quality = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS q FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id),
k AS (SELECT *, -ln((('0x' || m[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / q AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY 1),
f AS (SELECT *, coalesce(sum(3 * source_size) OVER b, 0)::DOUBLE AS full_, coalesce(sum(w) OVER b, 0)::DOUBLE AS spent, (sum(source_size) OVER ())::DOUBLE AS size, (sum(w) OVER ())::DOUBLE AS weight
    FROM s WINDOW b AS (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, 3 * source_size <= (size - full_) * w / (weight - spent) AS stops FROM f),
j AS (SELECT *, size - coalesce(sum(3 * source_size) FILTER (stops) OVER (), 0)::DOUBLE AS rest, weight - coalesce(sum(w) FILTER (stops) OVER (), 0)::DOUBLE AS left_ FROM g),
t AS (SELECT source, source_size, CASE WHEN stops THEN 3.0 * source_size ELSE least(3.0 * source_size, w * rest / left_) END::DOUBLE AS target FROM j),
x AS (SELECT k.*, source_size, target, floor(target + 0.5)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, size, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM k JOIN t ON t.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, (size * (budget // greatest(source_size, 1)) + least(size, greatest(budget % greatest(source_size, 1) - before, 0)))::BIGINT AS taken FROM x
"""
