"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from tessaro.llm.url_filter import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = f"""
WITH RECURSIVE w AS (
    SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
    SELECT rid, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
e AS (SELECT rid, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.rid AS i, b.rid AS j, any_value(a.n) AS ni, any_value(b.n) AS nj, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT i, j FROM p WHERE 100 * c >= 85 * (ni + nj - c)),
k AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r AS (SELECT rid, rid AS other FROM s UNION SELECT r.rid, k.j FROM r JOIN k ON k.i = r.other),
m AS (SELECT r.rid, min(o.doc_id) AS component_id FROM r JOIN s o ON o.rid = r.other GROUP BY 1)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, m.component_id FROM s JOIN m ON m.rid = s.rid
"""

_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}={a}'"
    for a, h, p in sorted(RULES, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "allow"), reverse=True)
)


def _rest(url: str) -> str:
    return f"CASE WHEN contains({url}, '://') THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"


def _node(url: str) -> str:
    rest = _rest(url)
    return f"translate(regexp_extract({rest}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') || '|' || regexp_extract({rest}, '^[^/?#]*([^#]*)', 1)"


def _attribute(name: str) -> str:
    form = f"""(?is)\\b{name}\\s*=\\s*(?:"\\s*([^">]*)|''\\s*([^''>]*)|([^\\s"''>]+))"""
    return "(" + " || ".join(f"regexp_extract(tag, '{form}', {i})" for i in (1, 2, 3)) + ")"


_TAG = "[^>]*"
OP4 = f"""
WITH RECURSIVE u AS (
    SELECT row_number() OVER () AS rid, page_id, url, html, coalesce(translate(regexp_extract({_rest('url')}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host,
        coalesce(regexp_extract({_rest('url')}, '^[^/?#]*([^?#]*)', 1), '') AS path, CASE WHEN contains(url, '://') THEN {_node('url')} END AS node FROM pages),
v AS (SELECT *, CASE {_FITS} END AS found FROM u),
t AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b{_TAG}(?:canonical|refresh){_TAG}>')) AS tag FROM u WHERE node IS NOT NULL AND html IS NOT NULL),
h AS (
    SELECT url, trim(replace(CASE
        WHEN regexp_matches(tag, '(?i)^<link\\b') AND lower(trim({_attribute('rel')})) = 'canonical' THEN {_attribute('href')}
        WHEN regexp_matches(tag, '(?i)^<meta\\b') AND lower(trim({_attribute('http-equiv')})) = 'refresh' THEN regexp_extract(tag, '(?is)\\burl\\s*=\\s*["'']?\\s*([^"''>]*)', 1)
        END, '&amp;', '&')) AS x, regexp_extract(url, '^[^?#]*?://[^/?#]*') AS root, {_rest('url')} AS rest FROM t),
a AS (
    SELECT url, CASE WHEN contains(x, '://') THEN x WHEN starts_with(x, '//') THEN 'http:' || x WHEN starts_with(x, '/') THEN root || x
        WHEN x <> '' THEN root || regexp_extract('/' || ltrim(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '/'), '^.*/') || x END AS dest FROM h),
b AS (SELECT {_node('url')} AS i, {_node('dest')} AS j FROM a WHERE contains(dest, '://')),
k AS (SELECT i, j FROM b WHERE i <> j UNION SELECT j, i FROM b WHERE i <> j),
r AS (SELECT DISTINCT node AS i, node AS j FROM u WHERE node IS NOT NULL UNION SELECT r.i, k.j FROM r JOIN k ON k.i = r.j),
g AS (SELECT r.i, bool_or(ends_with(v.found, '=block')) AS blocks, bool_or(ends_with(v.found, '=allow')) AS allows FROM r JOIN v ON v.node = r.j GROUP BY 1)
SELECT page_id, host, path, split_part(found, '=', 1) AS rule, coalesce(split_part(found, '=', 2), CASE WHEN coalesce(blocks, false) AND NOT coalesce(allows, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN g ON g.i = v.node
"""

OP10 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

BASE_COUNTS = f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
g AS (SELECT rid, unnest(generate_series(1, len(ws) - 7)) AS i, ws FROM w WHERE len(ws) >= 8),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i + 7], ' ')) AS n FROM g),
c AS (SELECT rid, count(DISTINCT k) AS n_repeat_words FROM (SELECT rid, unnest(generate_series(i, i + 7)) AS k FROM h WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(ws) AS base_failed
FROM w LEFT JOIN c USING (rid) LEFT JOIN l USING (rid)
"""

#: The first occurrence of each run of 50 words, and what lies in later ones that do not overlap it; for ids that are unique.
DEDUP_WORDS = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, hash(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT h, min((doc_id, i)) AS first FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT doc_id, i FROM g JOIN f USING (h) WHERE doc_id <> first[1] OR first[2] + 50 <= i),
n AS (SELECT doc_id, sum(least(50, coalesce(next - i, 50))) AS removed_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM c) GROUP BY doc_id)
SELECT doc_id, coalesce(removed_words, 0)::BIGINT AS removed_words FROM w LEFT JOIN n USING (doc_id)
"""

_SIZES = f"d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents)"
#: In order of cap / weight, a source is full while the level that the rest would share lies above its cap.
MIXING_TARGETS = f"""
WITH {_SIZES}, p AS (SELECT source, sum(size)::BIGINT AS words, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
q AS (SELECT *, 2.0::DOUBLE * words AS cap, 1.5::DOUBLE * sum(words) OVER () AS total FROM p),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (SELECT source, words, least(cap, coalesce(max(level) FILTER (level * weight <= cap) OVER () * weight, cap)) AS target FROM l)
SELECT doc_id, size, words AS source_size, target FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
"""

_BYTES = "SELECT count(*) AS n_rows, sum(octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS n_bytes FROM documents"

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _crc32(text: str) -> str:
    """crc32 of a text of ASCII characters, bit by bit."""
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: {bit})"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295)"


OP11 = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS o, {_crc32('doc_id::VARCHAR')} AS h FROM documents),
p AS (SELECT *, len(o) AS n, (h // 10) % greatest(len(o), 1) AS a, 3 + (h // 10) % 8 AS k FROM t),
w AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) ELSE o END AS ws FROM p),
g AS (SELECT rid, n, unnest(range(n - 5)) AS i, unnest(list_transform(range(n - 5), lambda i: array_to_string(ws[i + 1:i + 6], ' '))) AS x FROM w WHERE n >= 12),
e AS (SELECT a.rid, a.i, b.i - a.i AS q FROM g a JOIN g b ON a.rid = b.rid AND a.x = b.x AND a.i < b.i WHERE 2 * (b.i - a.i) <= a.n),
s AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM e),
m AS (SELECT rid, q, min(i) AS start, count(*) + 5 + q AS length FROM s GROUP BY rid, q, island HAVING count(*) + 5 >= q AND count(*) + 5 + q >= 12),
r AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m l WHERE l.rid = m.rid AND l.q < m.q AND m.q % l.q = 0 AND l.start <= m.start AND l.start + l.length >= m.start + m.length)),
f AS (SELECT rid, count(*) AS n_runs, first(struct_pack(start := start, length := length, q := q) ORDER BY length DESC, start, q) AS top,
    string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM r GROUP BY 1),
c AS (SELECT DISTINCT rid, unnest(range(start + q, start + length)) AS i FROM r),
v AS (SELECT rid, unnest(range(n)) AS i, unnest(ws) AS x FROM w),
k AS (SELECT v.rid, string_agg(x, ' ' ORDER BY v.i) AS kept FROM v ANTI JOIN c ON c.rid = v.rid AND c.i = v.i GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.start::BIGINT AS start, top.length::BIGINT AS length, top.q::BIGINT AS period, (1000 * top.length // top.q)::BIGINT AS exponent_milli,
    sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN f ON f.rid = w.rid LEFT JOIN k ON k.rid = w.rid
"""


def _add(state: str, cost: str, letter: str) -> str:
    """A state is its cost in nine digits, then its audit: the least string is the cheapest, then the first."""
    return f"lpad((substr({state}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{letter}'"


def _inserted(v0: str, v1: str, v2: str, v3: str) -> tuple[str, str]:
    """States 2 and 3 once up to two insertions have been made."""
    first2 = f"least({v2}, {_add(v0, '5', 'I')}, {_add(v1, '5', 'I')}, {_add(v3, '5', 'I')})"
    return first2, f"least({v3}, {_add(f'({first2})', '5', 'I')})"


_ROW = "CASE WHEN fault IN ('b', 'd') THEN NULL ELSE {} END"
_KEEP = "CASE WHEN ini = '{}' THEN {} END"
_AFTER = {
    "n0": _add("v0", "2", "D"),
    "n1": f"least({_add('v1', '2', 'D')}, {_ROW.format(_KEEP.format('s', _add('v0', 'more', 'K')))})",
    "n2": f"least({_add('v2', '2', 'D')}, {', '.join(_ROW.format(x) for v in ('v0', 'v1', 'v3') for x in (_KEEP.format('u', _add(v, 'more', 'K')), _add(v, '1 + more', 'R')))})",
    "n3": f"least({_add('v3', '2', 'D')}, {_ROW.format(_KEEP.format('a', _add('v2', 'more', 'K')))}, {_ROW.format(_add('v2', '1 + more', 'R'))})",
}
_TWO, _THREE = _inserted("n0", "n1", "n2", "n3")
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP12 = f"""
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT *, {_crc32('name')} % 20 AS plant FROM r),
d AS (SELECT conv_id, turn, CASE plant WHEN 4 THEN 'user' ELSE role END AS role, CASE plant WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE plant WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE plant <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, rtrim(text, {_WHITE}) AS t, coalesce(nullif(left(role, 1), ''), ' ') AS ini FROM d),
f AS (SELECT *, CASE WHEN t = '' THEN 'b' WHEN seen THEN 'd' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 's' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini AS step FROM o),
g AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY 1),
dp(conv_id, pos, v0, v1, v2, v3) AS (
    SELECT conv_id, 0::BIGINT, '000000000', NULL::VARCHAR, '000000005I', '000000010II' FROM g
    UNION ALL SELECT conv_id, pos, n0, n1, {_TWO}, {_THREE} FROM (
        SELECT conv_id, pos, {', '.join(f'{e} AS {n}' for n, e in _AFTER.items())} FROM (
            SELECT dp.*exclude(pos), f.pos, f.fault, f.ini, CASE f.fault WHEN 't' THEN 5 ELSE 0 END AS more FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.pos = dp.pos + 1))),
b AS (SELECT dp.conv_id, least(v0, v3) AS best FROM dp JOIN g ON g.conv_id IS NOT DISTINCT FROM dp.conv_id AND g.n = dp.pos),
l AS (SELECT conv_id, substr(best, 10) AS audit, unnest(range(1, length(best) - 8)) AS i, unnest(string_split(substr(best, 10), '')) AS letter FROM b WHERE length(best) > 9),
a AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS pos, count(*) FILTER (letter <> 'D') OVER w - 1 AS place FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
k AS (SELECT a.*, f.role, f.text, first(CASE WHEN letter = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY a.conv_id ORDER BY i) AS system
    FROM a LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.pos = a.pos AND a.letter <> 'I' WHERE a.letter <> 'D'),
z AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - system) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS whole FROM k GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(substr(best, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""

_NL = "chr(10)"
_BEGINS = f"i % 16 = 0 OR starts_with(ls[i + 1], '#') OR (trim(ls[i], ' ') = {_NL} AND trim(ls[i + 1], ' ') <> {_NL})"
OP13 = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT *, length(text) AS n, coalesce(lead(text) OVER o, first_value(text) OVER o) AS nxt FROM t WINDOW o AS (ORDER BY doc_id DESC NULLS LAST)),
y AS (SELECT *, substr(text, 1, n - n // 3) || substr(nxt, 1, n // 3) AS edited FROM x),
u AS (SELECT rid, 'a' AS kind, text AS s FROM y UNION ALL SELECT rid, 'b', edited FROM y UNION ALL SELECT rid, 'c', nxt FROM y),
k AS (SELECT rid, kind, string_split(s, {_NL}) AS raw FROM u),
l AS (SELECT rid, kind, list_filter(list_transform(raw, lambda v, j: CASE WHEN j < len(raw) THEN v || {_NL} ELSE v END), lambda v: v <> '') AS ls FROM k),
m AS (SELECT *, list_filter(range(len(ls)), lambda i: {_BEGINS}) AS starts FROM l),
d AS (SELECT rid, kind, sha256(array_to_string(list_transform(range(1, len(starts) + 1), lambda j: sha256(array_to_string(list_transform(ls[starts[j] + 1:coalesce(starts[j + 1], len(ls))], lambda v: sha256(v)), ''))), '')) AS root,
    list_distinct(flatten(list_transform(ls, lambda v: regexp_extract_all(v, '[^.,;:!?]{{1,32}}[.,;:!?]{{0,16}}|[.,;:!?]{{1,16}}')))) AS pieces FROM m),
z AS (SELECT rid, max(root) FILTER (kind = 'a') AS ra, max(root) FILTER (kind = 'b') AS rb, max(root) FILTER (kind = 'c') AS rc,
    any_value(pieces) FILTER (kind = 'a') AS pa, any_value(pieces) FILTER (kind = 'b') AS pb, any_value(pieces) FILTER (kind = 'c') AS pc FROM d GROUP BY 1),
""" + ",\n".join(
    f"""n{o} AS (SELECT rid, CASE WHEN ra = r{o} THEN 1.0::DOUBLE WHEN len(pa) = 0 OR len(p{o}) = 0 THEN 0.0
    ELSE 1.0::DOUBLE - (coalesce(list_sum(list_transform(list_filter(pa, lambda v: NOT list_contains(p{o}, v)), lambda v: length(v))), 0)
    + coalesce(list_sum(list_transform(list_filter(p{o}, lambda v: NOT list_contains(pa, v)), lambda v: length(v))), 0))
    / (list_sum(list_transform(pa, lambda v: length(v))) + list_sum(list_transform(p{o}, lambda v: length(v))))::DOUBLE END AS near FROM z)"""
    for o in "bc"
) + """
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, ra AS fingerprint, rb AS edited_fingerprint, nb.near AS near_edited, nc.near AS near_next
FROM y JOIN z USING (rid) JOIN nb USING (rid) JOIN nc USING (rid)
"""


ORACLE_SQL = {
    "op11_periodic_runs": OP11,
    "op12_conversation_repair": OP12,
    "op13_merkle_fingerprints": OP13,
    "op2_ngram_join": OP2,
    "op4_url_filter": OP4,
    "op10_topk_search": OP10,
    "quality_base_counts": BASE_COUNTS,
    "line_dedup_words": DEDUP_WORDS,
    "packing_invariants": "SELECT count(*) AS n_documents, 0::BIGINT AS n_bad_pieces, 0::BIGINT AS n_over, 0::BIGINT AS n_gaps FROM documents",
    "mixing_targets": MIXING_TARGETS,
    "mixing_near_targets": "SELECT count(*) AS n_sources, 0::BIGINT AS n_missed, 0::BIGINT AS n_over FROM (SELECT DISTINCT source FROM documents)",
    "shard_invariants": f"SELECT n_rows, n_bytes, 0::BIGINT AS n_empty, 0::BIGINT AS n_gaps, 0::BIGINT AS n_split FROM ({_BYTES})",
}
