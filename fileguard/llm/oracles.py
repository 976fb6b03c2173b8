"""SQL twins of the text operators that SQL can express."""

from __future__ import annotations

from fileguard.llm.license_scan import NOTICES

# 5-word windows as text; the words that any repeated window covers are counted.
QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
         regexp_replace(t, '[^\p{L}]', '', 'g') AS letters
  FROM d
),
m AS (
  SELECT doc_id, t, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, length(letters) AS n_letters,
         length(regexp_replace(letters, '[^\p{Lu}]', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^!?]', '', 'g')) AS n_marks
  FROM w
),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)
),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id
),
j AS (
  SELECT m.*, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         n_words < 10 OR 100 * coalesce(cov.n, 0) > 20 * n_words AS base_failed
  FROM m LEFT JOIN cov USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_letters < 6 * word_chars OR 2 * n_upper > n_letters
            OR 5 * n_marks > n_words) AS kept
FROM j
"""

# Lengths instead of texts: a block is <role>, line feed, text, <end>, line feed, with one more character for each escape.
CHAT = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
b AS (
  SELECT *, length(role) + length(said) + 9 + length(regexp_replace(role || said, '[^\\<>]', '', 'g')) AS size,
         len(regexp_extract_all(said, '[\p{L}\p{N}]+|[^\x09-\x0D\x20\p{L}\p{N}]')) + 3 AS tokens
  FROM r
),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said) AS place FROM b),
y AS (SELECT conv_id, min(place) AS sys_place FROM o WHERE role = 'system' GROUP BY conv_id),
p AS (
  SELECT o.*, y.sys_place, z.tokens AS sys_tokens, z.size AS sys_size,
         greatest(1, 1024 - 256 - coalesce(z.tokens, 0)) AS room,
         sum(o.tokens) OVER (PARTITION BY o.conv_id ORDER BY o.place) AS until
  FROM o LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN o z ON z.conv_id IS NOT DISTINCT FROM o.conv_id AND z.place = y.sys_place
),
c AS (
  SELECT *, (until - 1) // room AS cell, sum(tokens) OVER w AS held, count(*) OVER w AS members, min(place) OVER w AS lead
  FROM p WINDOW w AS (PARTITION BY conv_id, (until - 1) // room)
),
s AS (
  SELECT conv_id, cell, members > 1 AND held > room AND place > lead AS half, min(place) AS begins, sum(tokens) AS own, sum(size) AS chars,
         max(CASE WHEN sys_place < lead OR (sys_place = lead AND members > 1 AND held > room AND place > lead) THEN sys_tokens END) AS st,
         max(CASE WHEN sys_place < lead OR (sys_place = lead AND members > 1 AND held > room AND place > lead) THEN sys_size END) AS ss
  FROM c GROUP BY conv_id, cell, half
),
h AS (
  SELECT s.*, coalesce(a.tokens, 0) AS t1, coalesce(a.size, 0) AS s1, coalesce(e.tokens, 0) AS t2, coalesce(e.size, 0) AS s2,
         1024 - own - coalesce(st, 0) AS spare
  FROM s
  LEFT JOIN p a ON a.conv_id IS NOT DISTINCT FROM s.conv_id AND a.place = begins - 1 AND a.place IS DISTINCT FROM a.sys_place
  LEFT JOIN p e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.place = begins - 2 AND e.place IS DISTINCT FROM e.sys_place
),
f AS (
  SELECT conv_id, sum(chars + coalesce(ss, 0) + CASE WHEN t1 > spare THEN 0 WHEN t1 + t2 > spare THEN s1 ELSE s1 + s2 END) AS chars
  FROM h GROUP BY conv_id
)
SELECT p.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(said) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN said END, '' ORDER BY place), '')) AS loss_sha256,
       any_value(f.chars)::BIGINT AS formatted_chars
FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY p.conv_id
"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The rules, written down once more: which lines state a holder, which spellings are one, and what short notices become.
_SAME = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("cc0", "cc zero"),
         ("v2", "version 2"), ("v3", "version 3"), ("noncommercial", "nc"), ("organisation", "organization")]
_STATED = """(regexp_matches(l, '(?i)^[^\\p{L}\\x{A9}(]*(copyright[ \\t:]*(\\(c\\)|\\x{A9}|by\\b|[0-9]{4}|[\\[{<](yyyy|year)[\\]}>])|\\(c\\)[ \\t]*(copyright\\b|[0-9]{4}|[\\[{<]yyyy[\\]}>])|\\x{A9})')
  OR (regexp_full_match(l, '[^\\p{L}\\x{A9}(]*Copyright[ \\t]+\\p{Lu}[\\p{L}\\p{N}.''\\-]*([ \\t,]+(\\p{Lu}[\\p{L}\\p{N}.''\\-]*|&|and|of|the|et|al|und|y))*[ \\t.,\\r]*')
      AND NOT regexp_matches(l, '^[^\\p{L}]*Copyright[ \\t]+(License|Notice|Holder|Owner|Act\\b|Law)')))""".replace("\\\\", "\\")
_SHORT = [
    ("MIT", "released under the mit license"), ("MIT", "licensed under the mit license"), ("Apache-2.0", "licensed under the apache license version 2 0"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"), ("CC-BY-NC-4.0", "licensed under cc by nc 4 0"),
    ("CC0-1.0", "released under cc zero 1 0"), ("Proprietary", "all rights reserved"),
]


def _canonical(text: str) -> str:
    text = f"array_to_string(list_transform(string_split({text}, chr(10)), lambda l: CASE WHEN {_STATED} THEN '' ELSE l END), chr(10))"
    text = f"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    for other, word in _SAME:
        text = f"regexp_replace({text}, '\\b{other}\\b', '{word}', 'g')"
    return text


def _unit(text: str) -> str:
    return f"trim(regexp_replace({text}, '[ \\n]+', ' ', 'g'))"


def _whole(form: str) -> str:
    rest = f"array_to_string(list_filter(string_split({form}, chr(10)), lambda m: trim(m) <> 'all rights reserved'), chr(10))"
    return f"CASE WHEN {_unit(rest)} <> '' THEN {_unit(rest)} ELSE {_unit(form)} END"


# Short notices by the forms above, the others by the rule.
_OTHERS = [(name, text) for name, text in NOTICES if not any(name == x and len(text) < 80 for x, _ in _SHORT)]
LICENSES = f"""
WITH n AS (SELECT unnest([{", ".join(f"[{_quoted(a)}, {_quoted(b)}]" for a, b in _OTHERS)}]) AS x),
q AS (SELECT x[1] AS license_id, {_canonical("x[2]")} AS form FROM n),
k AS (SELECT digest, min(license_id) AS license_id FROM (
        SELECT sha256({_whole("form")}) AS digest, license_id FROM q
        UNION ALL SELECT sha256(y[2]), y[1] FROM (SELECT unnest([{", ".join(f"[{_quoted(a)}, {_quoted(b)}]" for a, b in _SHORT)}]) AS y)) GROUP BY 1),
c AS (SELECT doc_id, {_canonical("coalesce(text, '')")} AS form FROM documents),
w AS (SELECT doc_id, sha256({_whole("form")}) AS digest FROM c),
l AS (SELECT doc_id, sha256(trim(line)) AS digest FROM (SELECT doc_id, unnest(string_split(form, chr(10))) AS line FROM c)
      WHERE trim(line) <> ''),
f AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM l JOIN k USING (digest) GROUP BY 1)
SELECT w.doc_id, w.digest, k.license_id, coalesce(f.n, 0)::BIGINT AS n_license_lines, coalesce(f.ids, '') AS line_licenses
FROM w LEFT JOIN k USING (digest) LEFT JOIN f ON f.doc_id = w.doc_id
"""



def _crc_entry(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


# The checksum byte by byte; near words by what is left when one place is taken out.
VARIANTS = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM documents WHERE text IS NOT NULL
),
g AS (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= 7 GROUP BY 1, 2),
b AS (
  SELECT w, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''),
         lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS bytes
  FROM g
),
h AS (
  SELECT w, n, xor(list_reduce(list_concat([4294967295::BIGINT], bytes),
         lambda c, x: xor(c >> 8, ([{", ".join(str(_crc_entry(i)) for i in range(256))}]::BIGINT[])[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM b
),
e AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h),
c AS (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
v AS (SELECT word, n, i, substr(word, 1, i - 1) AS p, substr(word, i + 1) AS q FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM c)),
m AS (
  SELECT x.word, y.word AS other, y.n FROM v x JOIN v y ON x.i = y.i AND x.p = y.p AND x.q = y.q AND x.word <> y.word
  UNION SELECT v.word, c.word, c.n FROM v JOIN c ON c.word = v.p || v.q
  UNION SELECT c.word, v.word, v.n FROM v JOIN c ON c.word = v.p || v.q
),
k AS (SELECT word, count(*) AS n_near, max(n) AS most, first(other ORDER BY n DESC, other) AS other FROM m GROUP BY 1),
f AS (SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * c.n THEN other END AS form, CASE WHEN most >= 10 * c.n THEN most END AS form_n
      FROM c LEFT JOIN k USING (word)),
o AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT o.word, f.form, step + 1 FROM o JOIN f ON f.word = o.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, last.root, f.n, f.n_near, f.form_n
FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM o GROUP BY 1) AS last USING (word)
"""

ORACLES = {"op3_license_scan": LICENSES, "op8_quality_rules": QUALITY, "op9_chat_format": CHAT, "op11_spelling_variants": VARIANTS}
