"""The native operators' queries in DuckDB SQL, for the same rows."""

from __future__ import annotations

from veridect.llm.licenses import BASE_PHRASES, TEMPLATES
from veridect.llm.quality import BOILERPLATE, LineRules

_R = LineRules()
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _count(pattern: str, text: str = "l") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, {_WORDS.format("t")} AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, array_to_string(words[i:i + {_R.gram - 1}], ' ') AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - {_R.gram - 2})) AS i FROM w) s),
dup AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) s WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {_R.gram})) AS p FROM dup) s GROUP BY rid),
ln AS (SELECT rid, l, {_WORDS.format("l")} AS lw FROM (SELECT rid, unnest(lines) AS l FROM w) s),
judged AS (SELECT rid, length(l) AS chars, NOT (
    {_count('[#*$%&|<>]')} > {_R.symbol_share} * len(lw) OR {_count('!!')} > {_R.shout_share} * len(lw)
    OR {_count('[|»›]')} >= {_R.menu_links} AND {_count('[|»›]')} * 4 >= len(lw)
    OR len(lw) < {_R.open_words} AND NOT regexp_matches(l, '[.!?:;)"…”。！？]\s*$')
    OR len(lw) >= {_R.min_words} AND len(list_distinct(lw)) < {_R.min_distinct_share} * len(lw)
    OR regexp_matches(lower(l), '{BOILERPLATE}')) AS ok FROM ln),
lost AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE NOT ok) AS n_bad, sum(chars) AS every, coalesce(sum(chars) FILTER (WHERE ok), 0) AS good FROM judged GROUP BY rid),
base AS (SELECT w.*, coalesce(cov.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_bad, 0) AS n_lines_removed,
                CASE WHEN every > 0 THEN 1e2 * (every - good) / every ELSE 0e0 END AS lost_percent
         FROM w LEFT JOIN cov ON w.rid = cov.rid LEFT JOIN lost ON w.rid = lost.rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
       CAST({_count('[#*$%&|<>]', 't')} AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words,
       len(words) < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * len(words) AS base_failed,
       NOT (len(words) < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * len(words)) AND lost_percent <= {_R.max_lost_percent} AS kept,
       n_lines, n_lines_removed, floor(lost_percent * 1e6 + 5e-1) / 1e6 AS lost_percent FROM base"""

_LINE_WORDS = r"list_filter(string_split_regex(regexp_replace(l, '[^\s]*[0-9][^\s]*', '<*>', 'g'), '\s+'), lambda x: x <> '')"


def _general(path: int) -> str:
    return ", ".join(
        f"'{r + 1} ' || len(lw) || ' ' || array_to_string(list_filter(lw, lambda t, i: i <= {path} OR (i - {path + 1}) % 3 <> {r}), ' ')" for r in range(3)
    )



LINES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
ln AS (SELECT rid, doc_id, text, no, l, {_LINE_WORDS} AS lw
       FROM (SELECT rid, doc_id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM d) s),
ks AS (SELECT *, CASE WHEN len(lw) = 0 THEN [] WHEN len(lw) < 4 OR len(lw) > 24 THEN ['0 ' || len(lw) || ' ' || array_to_string(lw, ' ')]
       WHEN len(lw) < 8 THEN ['0 ' || len(lw) || ' ' || array_to_string(lw, ' '), {_general(1)}, '4 ' || len(lw) || ' ' || array_to_string(lw[2:], ' ')]
       ELSE ['0 ' || len(lw) || ' ' || array_to_string(lw, ' '), {_general(2)}] END AS k FROM ln),
occ AS (SELECT DISTINCT rid, doc_id, text, unnest(k) AS key FROM ks),
rec AS (SELECT key, min(doc_id) AS first_doc FROM occ GROUP BY key HAVING count(*) >= 5 AND count(DISTINCT text) > 1),
gone AS (SELECT DISTINCT o.rid, o.no FROM (SELECT rid, doc_id, no, unnest(k) AS key FROM ks) o JOIN rec ON o.key = rec.key WHERE o.doc_id IS DISTINCT FROM rec.first_doc),
kept AS (SELECT ln.rid, count(*) AS n_lines, count(gone.no) AS n_removed, coalesce(string_agg(l, chr(10) ORDER BY ln.no) FILTER (WHERE gone.no IS NULL), '') AS t
         FROM ln LEFT JOIN gone ON ln.rid = gone.rid AND ln.no = gone.no GROUP BY ln.rid)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(t) END AS kept_sha256
FROM d LEFT JOIN kept ON d.rid = kept.rid"""

_BASE = [(i, p.split(), label) for i, (p, label) in enumerate(BASE_PHRASES.items())]
_TEMPLATE_ROWS = ", ".join(f"({i}, '{label}', '{text}', ' {must} ')" for i, (label, text, must) in enumerate(TEMPLATES))

LICENSES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
    FROM documents),
b AS (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS norm,
    {", ".join(f"list_filter(range(len(words)), lambda i: words[i + 1:i + {len(p)}] = {p}) AS p{i}" for i, p, _ in _BASE)} FROM d),
tpl AS (SELECT * FROM (VALUES {_TEMPLATE_ROWS}) v(tno, label, body, must)),
tw AS (SELECT tno, unnest(string_split(body, ' ')) AS word, generate_subscripts(string_split(body, ' '), 1) - 1 AS tpos FROM tpl),
places AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
df AS (SELECT word, count(DISTINCT rid) AS df FROM places WHERE word IN (SELECT word FROM tw) GROUP BY word),
posting AS (SELECT *, count(*) OVER (PARTITION BY tno) AS indexed
            FROM (SELECT tw.*, row_number() OVER (PARTITION BY tno ORDER BY coalesce(df, 0), tw.word, tpos) AS rk FROM tw LEFT JOIN df ON tw.word = df.word) r WHERE rk <= 5),
votes AS (SELECT rid, tno, pos - tpos AS shift, count(DISTINCT tpos) / CAST(any_value(indexed) AS DOUBLE) AS share
          FROM places JOIN posting ON places.word = posting.word GROUP BY rid, tno, pos - tpos),
own AS (SELECT votes.rid, list_distinct(list(label)) AS labels, max(share) AS best
        FROM votes JOIN tpl ON votes.tno = tpl.tno JOIN b ON votes.rid = b.rid WHERE share >= 0.6 AND contains(norm, must) GROUP BY votes.rid),
s AS (SELECT b.*, own.labels AS own_labels, own.best, p0 || p1 || p2 AS every,
             list_filter([{", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, _, label in _BASE)}], lambda x: x IS NOT NULL) AS base
      FROM b LEFT JOIN own ON b.rid = own.rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, CAST(list_min(every) AS BIGINT) AS first_word, CAST(list_max(every) AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(base || coalesce(own_labels, []))), ','), '') AS labels,
       CASE WHEN len(every) > 0 THEN 1e0 ELSE coalesce(round(best, 9), 0e0) END AS score FROM s"""

#: DuckDB has no crc32: a fold over bytes and shifts.
_CRC32 = """xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT)"""

TRIE = rf"""
WITH c AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, {_CRC32} % 9 AS h FROM c),
p AS (SELECT h.conv_id, coalesce(b.turns[:h.h], []) || h.turns[h.h + 1:] AS path FROM h LEFT JOIN c AS b ON b.conv_id = h.conv_id - h.conv_id % 5),
member AS (SELECT conv_id, path[:d] AS node, d, d = len(path) AS last FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM p) s),
nodes AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends
          FROM member GROUP BY node, d),
kids AS (SELECT node[:d - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(nodes.node[d].t) END AS saved FROM nodes LEFT JOIN kids ON kids.node = nodes.node),
below AS (SELECT node[:up] AS node, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
          FROM (SELECT node, saved, n_children, unnest(range(d + 1)) AS up FROM own) s GROUP BY 1)
SELECT own.conv_id, CAST(own.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, below.leaves AS n_leaves,
       CAST(below.saved AS BIGINT) AS saved_tokens, own.ends AS ends_sha256
FROM own JOIN below ON below.node = own.node LEFT JOIN nodes AS up ON own.d > 0 AND up.node = own.node[:own.d - 1]"""
