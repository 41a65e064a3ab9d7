"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

from mezze.llm import licenses, linedup, quality

_GAPS = r"[\x20\x09-\x0D]+"
_WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), '{_GAPS}'), lambda x: x <> '')"

LINES = rf"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS nth
  FROM documents
), keyed AS (SELECT *, regexp_replace(line, '^{_GAPS}|{_GAPS}$', '', 'g') AS k FROM lines),
spread AS (
  SELECT k, min(doc_id) AS first_id FROM keyed WHERE k <> ''
  GROUP BY k HAVING count(DISTINCT coalesce('=' || source, '')) >= {linedup.MIN_SITES}
), marked AS (
  SELECT keyed.*, spread.k IS NOT NULL AND first_id <> doc_id AS gone FROM keyed LEFT JOIN spread ON keyed.k = spread.k
)
SELECT doc_id, count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""

NEAR = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_GAPS}'), lambda x: x <> '') AS ws
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s
  FROM w
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
crossed AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM crossed WHERE 100 * i >= 85 * (na + nb - i)),
reach AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.to_id = l.a),
least AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""


#: crc32 of a decimal number, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""

TRIE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
keyed AS (SELECT conv_id, turn, length(text) AS chars, sha256(length(role) || ':' || role || text) AS k FROM t),
s AS (
  SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ids, list(chars ORDER BY turn NULLS FIRST, k) AS chars, CAST({_CRC} % 6 AS BIGINT) AS h
  FROM keyed GROUP BY conv_id
), r AS (
  SELECT c.conv_id, list_concat(coalesce(d.ids[1:c.h], []), c.ids[c.h + 1:]) AS ids, list_concat(coalesce(d.chars[1:c.h], []), c.chars[c.h + 1:]) AS chars
  FROM s c LEFT JOIN s d ON d.conv_id = c.conv_id - c.conv_id % 100
), p AS (
  SELECT conv_id, depth, ids[1:depth] AS prefix, CASE WHEN depth = 0 THEN 0 ELSE chars[depth] END AS chars, depth = len(ids) AS ends
  FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS depth FROM r)
), n AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY prefix, depth
), kids AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (prefix)),
above AS (SELECT prefix[1:up] AS prefix, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM nodes) GROUP BY 1)
SELECT x.conv_id, x.depth, u.conv_id AS parent_conv_id, x.n_convs, CAST(x.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM nodes x JOIN above USING (prefix) LEFT JOIN n u ON x.depth > 0 AND u.prefix = x.prefix[1:x.depth - 1]
"""


def _list(values) -> str:
    return "[" + ", ".join(f"{v!r}e0" if isinstance(v, float) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _js(p: str, q: str) -> str:
    part = lambda x, m: f"(CASE WHEN {x} > 0 THEN {x} * log2({x} / {m}) ELSE 0e0 END)"
    term = f"({part(f'{p}[i]', f'(({p}[i] + {q}[i]) / 2)')} + {part(f'{q}[i]', f'(({p}[i] + {q}[i]) / 2)')}) / 2"
    return f"sqrt(greatest(0e0, list_sum(list_transform(range(1, len({q}) + 1), lambda i: {term}))))"


def quality_sql(min_words: int = 50, max_repeat_percent: int = 50, most_words: float = 0.45, most_classes: float = 0.2, guard_words: int = 50, guard_chars: int = 200, most_share: float = 0.85, most_nearer: float = 0.15) -> str:
    refs = []
    for pos, (lang, common) in enumerate(quality.COMMON.items()):
        shares = [v / 100 for v in common.values()]
        classes = [v / sum(quality.CLASSES[lang]) for v in quality.CLASSES[lang]]
        refs.append(f"('{lang}', {_list(common)}, {_list([*shares, 1 - sum(shares)])}, {_list(classes)}, {quality._without(lang)!r}e0, {pos})")
    return rf"""
WITH refs(of, ref_words, ref_h, ref_c, without, pos) AS (VALUES {', '.join(refs)}),
d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i,
    unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS h
  FROM d
), again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
repeated AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, length(text) AS n_text,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digits,
    length(text) - length(regexp_replace(text, '[.,;:!?''"()-]', '', 'g')) AS marks, length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS beyond,
    lang, list_filter(string_split_regex(lower(text), '{_GAPS}'), lambda x: x <> '') AS low
  FROM d LEFT JOIN repeated USING (doc_id)
), c AS (
  SELECT *, list_transform(ref_words, lambda r: len(list_filter(low, lambda x: x = r))) AS named,
    [greatest(0, n_text - upper - beyond - digits - (n_text - word_chars) - marks - n_symbols), upper, beyond, digits, n_text - word_chars, marks, n_symbols] AS classes
  FROM m, refs
), p AS (
  SELECT *, list_transform(list_append(named, n_words - list_sum(named)), lambda x: x / greatest(n_words, 1)::DOUBLE) AS ph,
    list_transform(classes, lambda x: x / greatest(list_sum(classes), 1)::DOUBLE) AS pc
  FROM c
), v AS (
  SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words AS failed,
    {_js('ph', 'ref_h')} AS dw, {_js('pc', 'ref_c')} AS dc
  FROM p
), shared AS (SELECT *, dw / without AS share FROM v),
judged AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_text, failed, min(share) AS least, coalesce(max(share) FILTER (lang = of), min(share)) AS share,
    coalesce(max(dw) FILTER (lang = of), min_by(dw, (share, pos))) AS dw, coalesce(max(dc) FILTER (lang = of), min(dc)) AS dc
  FROM shared GROUP BY ALL
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, failed AS base_failed,
  NOT failed AND (n_words < {guard_words} OR (dw <= {most_words}e0 AND share <= {most_share}e0 AND share - least <= {most_nearer}e0)) AND (n_text < {guard_chars} OR dc <= {most_classes}e0) AS kept
FROM judged
"""


_ESCAPED = "replace(replace(replace({}, '\\', '\\\\'), '<', '\\l'), '>', '\\g')"
CHAT = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(6 + length({_ESCAPED.format('role')}) + 2 + length({_ESCAPED.format('text')}) + 8)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p),
g AS (
  SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(8), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, i * 5 + 1, 5))::INTEGER >> 15) & 31) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, i * 5 + 1, 5))::INTEGER >> 10) & 31) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, i * 5 + 1, 5))::INTEGER >> 5) & 31) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, i * 5 + 1, 5))::INTEGER & 31) + 1, 1)), '') AS payload_digest
  FROM h
), f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM g)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def _canonical(text: str) -> str:
    c = f"'  ' || regexp_replace(regexp_replace(regexp_replace(lower({text}), '{licenses.TITLE}', ''), '{licenses.COPYRIGHT_LINE}', '', 'g'), '[{licenses.BETWEEN}]+', '  ', 'g') || '  '"
    for other, usual in licenses.SPELLINGS:
        c = f"replace({c}, ' {other.replace(' ', '  ')} ', ' {usual.replace(' ', '  ')} ')"
    return f"trim(replace({c}, '  ', ' '), ' ')"


def licenses_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in licenses.KNOWN)
    return f"""
WITH known(license, text) AS (VALUES {known}),
catalog AS (SELECT sha256({_canonical('text')}) AS digest, min(license) AS license FROM known GROUP BY 1),
d AS (SELECT doc_id, {_canonical("coalesce(text, '')")} AS c FROM documents),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
found AS (
  SELECT doc_id, list_sort(list(DISTINCT license)) AS line_licenses
  FROM (SELECT doc_id, sha256({_canonical('line')}) AS digest FROM lines) JOIN catalog USING (digest) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN c = '' THEN 0 ELSE length(c) - length(replace(c, ' ', '')) + 1 END::BIGINT AS n_words, sha256(c) AS canonical_sha256,
  license, coalesce(line_licenses, []) AS line_licenses
FROM d LEFT JOIN catalog ON sha256(c) = digest LEFT JOIN found USING (doc_id)
"""


def vectors_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """Rounds of assigning and moving, all distances worked out."""
    floor_div = "(s - ((s % n) + n) % n) // n"
    steps = []
    for k in range(rounds + 1):
        distance = "CAST(list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT)"
        steps.append(f"near{k} AS (SELECT v.row, v.p, min(struct_pack(d := {distance}, e := c.e)) AS best FROM cut v JOIN book{k} c ON v.p = c.p GROUP BY v.row, v.p)")
        if k < rounds:
            steps.append(f"sums{k} AS (SELECT v.p, best.e AS e, i, sum(v.x[i]) AS s, count(*) AS n FROM cut v JOIN near{k} USING (row, p), range(1, (SELECT max(len(x)) FROM cut) + 1) AS places(i) GROUP BY ALL)")
            steps.append(f"moved{k} AS (SELECT p, e, list({floor_div} ORDER BY i) AS x FROM sums{k} GROUP BY p, e)")
            steps.append(f"book{k + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN moved{k} m ON b.p = m.p AND b.e = m.e)")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS (
  SELECT row, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) AS places(p)
), book0 AS (SELECT p, row - 1 AS e, x FROM cut WHERE row <= {entries}),
{", ".join(steps)},
coded AS (SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY row),
labelled AS (SELECT vec_id, label, code, error FROM coded JOIN kept USING (row))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM labelled
"""
