"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from neardup.llm import chat, merkle, quality, spelling

SQL: dict[str, str] = {}


def _rule(r: quality.Rule) -> str:
    x = f"{r.over}::DOUBLE" if not r.under else f"(CASE WHEN {r.under} > 0 THEN {r.over}::DOUBLE / {r.under} ELSE 0 END)"
    return " AND ".join([f"{x} >= {r.low}"] * (r.low is not None) + [f"{x} <= {r.high}"] * (r.high is not None))


_STOPS = ", ".join(f"'{w}'" for w in sorted({w for ws in quality.STOP_WORDS.values() for w in ws}))

_WINDOW = "concat_ws(' ', x, " + ", ".join(f"lead(x, {k}) OVER v" for k in range(1, quality.WINDOW)) + ")"

SQL["op5_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
u AS (SELECT rid, unnest(w) AS x, unnest(range(len(w))) AS p, len(w) AS n FROM d),
g AS (SELECT rid, p, n, {_WINDOW} AS x FROM u WINDOW v AS (PARTITION BY rid ORDER BY p)),
h AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, x) AS c FROM g WHERE p + {quality.WINDOW} <= n),
k AS (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS q FROM h WHERE c > 1),
r AS (SELECT rid, sum(CASE WHEN q IS NULL THEN {quality.WINDOW} ELSE least({quality.WINDOW}, p - q) END) AS n FROM k GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop_words,
         len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*•]')))::BIGINT AS n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$')))::BIGINT AS n_ellipsis_lines
  FROM d LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(_rule(r) for r in quality.RULES)} AS kept
FROM b
"""

_HEADING = f"""CASE WHEN speaker = '{chat.SYSTEM}' THEN '<|system|>' || chr(10)
         WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
         ELSE '<|user|> ' || speaker || chr(10) END"""

SQL["op10_chat_rotation"] = f"""
WITH t AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(nullif(role, ''), '{chat.UNKNOWN}') AS speaker,
         coalesce(text, '') AS text
  FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker <> '{chat.SYSTEM}'),
h AS (SELECT t.*, perspective, {_HEADING} AS heading FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.c),
r AS (SELECT *, heading || text || chr(10) || '<|end|>' || chr(10) AS piece FROM h),
s AS (
  SELECT *, row_number() OVER w AS seq,
         coalesce(sum(length(piece)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM r WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text, rid))
SELECT conv_id, perspective, (start // {chat.PAGE_CHARS})::BIGINT AS page, min(start)::BIGINT AS start,
       count(*)::BIGINT AS n_turns, string_agg(piece, '' ORDER BY seq) AS text,
       coalesce(string_agg((start + length(heading))::VARCHAR || ':' || (start + length(heading) + length(text))::VARCHAR, ','
                           ORDER BY seq) FILTER (WHERE speaker = perspective), '') AS masks
FROM s GROUP BY conv_id, perspective, page
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _nibble(x: int) -> int:
    for _ in range(4):
        x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
    return x


_NIBBLES = [_nibble(x) for x in range(16)]


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a string's UTF-8 bytes, four bits at a time, low ones first."""
    hexed = f"hex(encode({text}))"
    digits = (f"list_transform(range(length({hexed})), lambda i: "
              f"(strpos('0123456789ABCDEF', substr({hexed}, CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END, 1)) - 1)::BIGINT)")
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), "
            f"lambda c, x: xor(({_NIBBLES}::BIGINT[])[xor(c & 15, x) + 1], c >> 4)), 4294967295::BIGINT)")


SQL["op11_spelling_variants"] = rf"""
WITH RECURSIVE
u AS (SELECT coalesce(doc_id::VARCHAR, '') AS name,
             translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS run
      FROM documents),
p AS (SELECT name || ':' || run AS named, run, count(*) AS c FROM u WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, c, {_crc32("named")} AS h FROM p),
r AS (SELECT CASE WHEN h % {spelling.TYPO_RATE} = 0
             THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM r WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
s AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d
                   FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT s.word AS a, s.n AS n_a, w.word AS b, w.n AS n_b FROM s JOIN w ON s.d = w.word
      UNION SELECT w.word, w.n, s.word, s.n FROM s JOIN w ON s.d = w.word
      UNION SELECT x.word, x.n, y.word, y.n FROM s x JOIN s y ON x.i = y.i AND x.d = y.d AND x.word <> y.word),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n_b DESC, encode(b)) AS rn, count(*) OVER (PARTITION BY a) AS n_near FROM e),
f AS MATERIALIZED (
  SELECT word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN n_b >= 5 * w.n THEN b END AS form,
         CASE WHEN n_b >= 5 * w.n THEN n_b END AS form_n
  FROM w LEFT JOIN k ON w.word = k.a AND rn = 1),
t AS (SELECT word, coalesce(form, word) AS root FROM f
      UNION SELECT t.word, f.form FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL),
z AS (SELECT t.word, t.root FROM t JOIN f ON t.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN z ON f.word = z.word
"""


def _leaf(text: str) -> str:
    fields = [c if c == "text" else f"{c}::VARCHAR" for c in merkle.FIELDS]
    fields = [text if c == "text" else c for c in fields]
    return "sha256(" + " || ".join(f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')" for c in fields) + ")"


_RUN = merkle.ARITY
_SIDES = f"""string_agg(y.digest, '' ORDER BY y.place) FILTER (WHERE y.place < x.place) AS before,
              string_agg(y.digest, '' ORDER BY y.place) FILTER (WHERE y.place > x.place) AS after"""

SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE
d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS tree, {_leaf("text")} AS leaf,
         {_leaf(f"CASE WHEN {_crc32('doc_id::VARCHAR')} % 5 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END")} AS claimed
  FROM documents),
p AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS place,
         count(*) OVER (PARTITION BY tree) AS total FROM d),
v AS (SELECT tree, 0 AS level, place, total, leaf AS digest FROM p
      UNION ALL
      SELECT tree, level + 1, place // {_RUN}, (total + {_RUN - 1}) // {_RUN}, sha256(string_agg(digest, '' ORDER BY place))
      FROM v WHERE total > 1 GROUP BY tree, level, place // {_RUN}, total),
s AS MATERIALIZED (SELECT tree, level, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS total
                   FROM v WHERE total = 1),
o AS (SELECT 0 AS level, place, total, digest FROM s
      UNION ALL
      SELECT level + 1, place // {_RUN}, (total + {_RUN - 1}) // {_RUN}, sha256(string_agg(digest, '' ORDER BY place))
      FROM o WHERE total > 1 GROUP BY level, place // {_RUN}, total),
nodes AS MATERIALIZED (
  SELECT tree, level, place, total, digest FROM v
  UNION ALL SELECT NULL, level, place, total, digest FROM o),
sides AS MATERIALIZED (
  SELECT x.tree, x.level, x.place, {_SIDES}
  FROM nodes x JOIN nodes y ON x.tree IS NOT DISTINCT FROM y.tree AND x.level = y.level AND x.place // {_RUN} = y.place // {_RUN}
  WHERE x.total > 1 GROUP BY x.tree, x.level, x.place),
a AS (
  SELECT rid, tree, tree AS at, 0 AS level, place, false AS over, claimed AS x, '' AS proof FROM p
  UNION ALL
  SELECT a.rid, a.tree, CASE WHEN sides.level IS NULL THEN NULL ELSE a.at END,
         CASE WHEN sides.level IS NULL THEN 0 ELSE a.level + 1 END,
         CASE WHEN sides.level IS NULL THEN s.place ELSE a.place // {_RUN} END, a.at IS NULL AND sides.level IS NULL,
         CASE WHEN sides.level IS NULL THEN a.x ELSE sha256(coalesce(before, '') || a.x || coalesce(after, '')) END,
         a.proof || coalesce(before, '') || coalesce(after, '')
  FROM a JOIN s ON a.tree = s.tree
  LEFT JOIN sides ON a.at IS NOT DISTINCT FROM sides.tree AND a.level = sides.level AND a.place = sides.place
  WHERE NOT a.over)
SELECT p.doc_id, p.leaf, s.digest AS subroot, top.digest AS root, sha256(a.proof) AS proof_sha256, a.x AS folded_root,
       a.x = top.digest AS verified
FROM p JOIN a ON p.rid = a.rid AND a.over JOIN s ON p.tree = s.tree JOIN (SELECT digest FROM o WHERE total = 1) top ON true
"""
