"""DuckDB reference SQL for the registered queries.

Written independently of the Spark plans (views: the driver tables); shared
only are the fixed values (extension lists, ranks, LSH positions), generated
from the same Python constants so both sides use the same literals.
"""

from __future__ import annotations

from neardup import constants as C
from neardup.functions.fingerprint import dct_basis
from neardup.operators.hamming import lsh_positions
from neardup.sources import fixtures as FX

T_TEXT = 32      # text fingerprints: at 10 the sf0.01 result would be empty
T_VEC = 18       # 64-bit vector fingerprints


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def _rank_case(ext: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.FORMAT_QUALITY_RANK.items())
    return f"(CASE {ext} {whens} ELSE {C.DEFAULT_FORMAT_RANK} END)"


EXT_SQL = r"regexp_extract(lower(path), '[^/.][^/]*(\.[^/.]*)$', 1)"


def quality_sql() -> str:
    d = "::DOUBLE"
    return (f"((CASE WHEN pixel_count > 0 THEN least(50.0{d}, pixel_count{d} / 1000000.0{d} * 2.0{d}) ELSE 0.0{d} END)"
            f" + (CASE WHEN file_size > 0 THEN least(30.0{d}, file_size{d} / 1048576.0{d} * 3.0{d}) ELSE 0.0{d} END)"
            f" + (CASE WHEN bit_depth > 0 THEN least(10.0{d}, bit_depth{d} / 3.2{d}) ELSE 0.0{d} END)"
            f" + {_rank_case(EXT_SQL)}{d} / 5.0{d})")


def hex_bit(h: str, p: int) -> str:
    return f"(((strpos('0123456789abcdef', substr({h}, {p // 4 + 1}, 1)) - 1) >> {3 - p % 4}) & 1)"


def hex_word(h: str, i: int) -> str:
    return f"('0x' || substr({h}, {16 * i + 1}, 16))::UBIGINT"


def signed(x: str) -> str:
    return (f"(({x})::HUGEINT - CASE WHEN ({x}) >= 9223372036854775808 "
            f"THEN 18446744073709551616::HUGEINT ELSE 0::HUGEINT END)::BIGINT")


def dist(a: str, b: str, n_words: int) -> str:
    return " + ".join(f"CAST(bit_count(xor({a}.w{i}, {b}.w{i})) AS INTEGER)" for i in range(n_words))


def one_decimal(x: str) -> str:
    return f"printf('%.1f', ({x})::DOUBLE)"


def size_sql(x: str) -> str:
    parts = []
    for i, unit in enumerate(C.SIZE_UNITS):
        s = f"(({x})::DOUBLE / {float(1024 ** i)})"
        parts.append(f"WHEN {s} < 1024.0 THEN {one_decimal(s)} || ' {unit}'")
    last = f"(({x})::DOUBLE / {float(1024 ** len(C.SIZE_UNITS))})"
    return f"(CASE {' '.join(parts)} ELSE {one_decimal(last)} || ' {C.SIZE_UNIT_LAST}' END)"


CTES: dict[str, tuple[tuple, str]] = {}


def cte(name: str, deps: tuple, body: str) -> None:
    CTES[name] = (deps, body)


def manifest_sql(rows: str, failing: bool = False) -> str:
    """Manifest columns from a (doc_id, text, lang, source, n_chars) relation."""
    bad = r"NOT coalesce(regexp_matches(text, '[^ \t\n\r]'), false)" + (
        f" OR doc_id % {FX.DOC_ERROR_EVERY} = 0" if failing else "")
    return f"""
SELECT doc_id AS id,
       '/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || ext AS path,
       {FX.DOC_MTIME_BASE} + doc_id AS mtime_s,
       CAST(strlen(text) AS BIGINT) * {FX.DOC_BYTES_PER_CHAR_BYTE} AS file_size,
       CAST(n_chars AS INTEGER) AS width,
       {FX.DOC_HEIGHT} AS height,
       CAST(n_chars AS BIGINT) * {FX.DOC_HEIGHT} AS pixel_count,
       bit_depth,
       CASE WHEN ext <> '' THEN upper(substr(ext, 2, 10)) END AS format,
       sha256(text) AS file_hash,
       CASE WHEN {bad} THEN '{FX.DOC_ERROR_TEXT}' END AS error
FROM (SELECT *, {_list(FX.DOC_EXTENSIONS)}[doc_id % {len(FX.DOC_EXTENSIONS)} + 1] AS ext,
             {_list(FX.DOC_BIT_DEPTHS)}[doc_id % {len(FX.DOC_BIT_DEPTHS)} + 1] AS bit_depth
      FROM {rows}) d"""


_PAGES = (f"(SELECT page_id AS doc_id, html AS text, '{FX.PAGES_LANG}' AS lang, "
          f"'{FX.PAGES_SOURCE}' AS source, CAST(length(html) AS BIGINT) AS n_chars FROM pages)")
# the second of each pair also has the errors by id, for the queries about errors
for _sfx, _failing in (("", False), ("_failing", True)):
    cte(f"m0{_sfx}", (), manifest_sql("documents", _failing))
    cte(f"wm0{_sfx}", (), manifest_sql(_PAGES, _failing))
    for _w in ("", "w"):
        cte(f"{_w}m{_sfx}", (f"{_w}m0{_sfx}",), f"SELECT *, CASE WHEN error IS NULL THEN {quality_sql()} "
                                               f"ELSE 0.0::DOUBLE END AS quality_score FROM {_w}m0{_sfx}")

# SimHash-256 of distinct whitespace tokens
cte("tok", (), r"""
SELECT DISTINCT doc_id, tok FROM (
  SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\n\r]+')) AS tok FROM documents) t
WHERE tok <> ''""")
cte("tokh", ("tok",), "SELECT doc_id, sha256(tok) AS h FROM tok")
cte("tokn", ("tokh",), "SELECT doc_id, count(*) AS n FROM tokh GROUP BY doc_id")
CTES["votes"] = (("tokh",), """
SELECT tokh.doc_id, b.pos,
       sum(((strpos('0123456789abcdef', substr(tokh.h, b.pos // 4 + 1, 1)) - 1) >> (3 - b.pos % 4)) & 1) AS ones
FROM tokh CROSS JOIN range(256) AS b(pos)
GROUP BY tokh.doc_id, b.pos""")
cte("fpx", ("votes", "tokn"), """
SELECT doc_id, string_agg(digit, '' ORDER BY nib) AS perceptual_hash FROM (
  SELECT v.doc_id, v.pos // 4 AS nib,
         substr('0123456789abcdef', CAST(sum(CASE WHEN v.ones * 2 > n.n THEN 1 ELSE 0 END << (3 - v.pos % 4)) AS INTEGER) + 1, 1) AS digit
  FROM votes v JOIN tokn n USING (doc_id)
  GROUP BY v.doc_id, v.pos // 4) q
GROUP BY doc_id""")
cte("valid", ("m", "fpx"), """
SELECT m.*, fpx.perceptual_hash FROM m LEFT JOIN fpx ON fpx.doc_id = m.id WHERE m.error IS NULL""")
cte("eg", ("valid",), """
SELECT file_hash, count(*) AS n, min(path) AS first_path FROM valid
WHERE file_hash IS NOT NULL GROUP BY file_hash HAVING count(*) > 1""")
cte("cand", ("valid", "eg"), """
SELECT v.* FROM valid v
WHERE v.perceptual_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM eg WHERE eg.file_hash = v.file_hash)""")
cte("reps", ("cand",), f"""
SELECT rep, perceptual_hash, {', '.join(hex_word('perceptual_hash', i) + f' AS w{i}' for i in range(4))}
FROM (SELECT perceptual_hash, min(id) AS rep FROM cand GROUP BY perceptual_hash) r""")
cte("copies", ("cand", "reps"), """
SELECT c.id, r.rep FROM cand c JOIN reps r USING (perceptual_hash) WHERE c.id <> r.rep""")
cte("pairs", ("reps",), f"""
SELECT a.rep AS src, b.rep AS dst, CAST({dist('a', 'b', 4)} AS INTEGER) AS distance
FROM reps a JOIN reps b ON a.rep < b.rep WHERE {dist('a', 'b', 4)} <= {T_TEXT}""")
cte("edges", ("pairs", "copies"), """
SELECT src AS a, dst AS b FROM pairs UNION ALL SELECT dst, src FROM pairs
UNION ALL SELECT id, rep FROM copies UNION ALL SELECT rep, id FROM copies""")
CTES["reach"] = (("edges",), "RECURSIVE:reach(id, c) AS (SELECT a, a FROM edges UNION "
                            "SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.id)")
cte("comp", ("reach",), "SELECT id, min(c) AS component FROM reach GROUP BY id")
cte("pm", ("cand", "comp"), "SELECT c.*, comp.component FROM cand c JOIN comp USING (id)")
cte("pfirst", ("pm",), "SELECT component, min(path) AS first_path FROM pm GROUP BY component")

_MEMBER = "id, path, mtime_s, width, height, file_size, quality_score"
cte("exact_members", ("valid", "eg"), f"""
SELECT {_MEMBER}, 'exact' AS match_type, file_hash AS gkey, eg.first_path, 0 AS t
FROM valid JOIN eg USING (file_hash)""")
cte("perc_members", ("pm", "pfirst"), f"""
SELECT {_MEMBER}, 'perceptual' AS match_type, CAST(component AS VARCHAR) AS gkey, pfirst.first_path, 1 AS t
FROM pm JOIN pfirst USING (component)""")
cte("all_members", ("exact_members", "perc_members"),
    "SELECT * FROM exact_members UNION ALL SELECT * FROM perc_members")


def ranked(members: str, order: str = "quality_score DESC, path") -> str:
    return f"""
SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY {order}) AS INTEGER) AS member_rank
FROM (SELECT *, dense_rank() OVER (ORDER BY t, first_path) AS group_id FROM {members}) n"""


cte("groups_exact", ("exact_members",), ranked("exact_members"))
cte("groups_all", ("all_members",), ranked("all_members"))

# store fixtures (B4)
for _sfx in ("", "_failing"):
    cte(f"store{_sfx}", (f"m{_sfx}", f"wm{_sfx}"), f"""
SELECT *, 1 AS analysis_version, mtime_s AS created_s,
       {FX.STORE_NOW} - (abs(id) % {FX.STORE_ACCESS_SPREAD_DAYS}) * {FX.DAY} AS last_accessed_s
FROM (SELECT * FROM m{_sfx} UNION ALL SELECT * REPLACE (-(id + 1) AS id) FROM wm{_sfx}) s""")
cte("listing", ("m",), f"""
SELECT id, path, mtime_s + CASE WHEN id % {FX.LISTING_CHANGED_EVERY} = 0 THEN {FX.DAY} ELSE 0 END AS mtime_s, file_size
FROM m""")

# vectors (B3)
cte("vfp", (), """
SELECT vec_id, list_reduce(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] >= list_sort(embedding)[33]
                 THEN (1::UBIGINT << (63 - i)) ELSE 0::UBIGINT END), lambda x, y: x | y) AS w0
FROM embeddings WHERE len(embedding) = 64""")
cte("vreps", ("vfp",), "SELECT w0, min(vec_id) AS rep FROM vfp GROUP BY w0")
cte("vcopies", ("vfp", "vreps"), "SELECT v.vec_id AS id, r.rep FROM vfp v JOIN vreps r USING (w0) WHERE v.vec_id <> r.rep")
cte("vpairs", ("vreps",), f"""
SELECT a.rep AS src, b.rep AS dst, CAST({dist('a', 'b', 1)} AS INTEGER) AS distance
FROM vreps a JOIN vreps b ON a.rep < b.rep WHERE {dist('a', 'b', 1)} <= {T_VEC}""")


# embeddings as gray pictures of 8 x 8: DCT hash in whole numbers
_BASIS = f"({dct_basis(8)}::BIGINT[])"
cte("dct", (), f"""
SELECT vec_id, list_reduce(list_transform(range(64), lambda i: CASE WHEN 2 * c[i + 1] > list_sort(c)[32] + list_sort(c)[33]
                 THEN (1::UBIGINT << (63 - i)) ELSE 0::UBIGINT END), lambda x, y: x | y) AS w0
FROM (SELECT vec_id, list_transform(range(64), lambda i: list_sum(list_transform(range(8),
               lambda y: t[y * 8 + i % 8 + 1] * {_BASIS}[(i // 8) * 8 + y + 1]))::BIGINT) AS c
FROM (SELECT vec_id, list_transform(range(64), lambda i: list_sum(list_transform(range(8),
               lambda x: p[(i // 8) * 8 + x + 1] * {_BASIS}[(i % 8) * 8 + x + 1]))::BIGINT) AS t
FROM (SELECT vec_id, list_transform(embedding, lambda e: coalesce(floor((e::DOUBLE - list_min(embedding)::DOUBLE) * 255.0::DOUBLE
               / nullif(list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE, 0.0::DOUBLE)), 0)::BIGINT) AS p
FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL)) = 0)))""")
cte("dct_reps", ("dct",), "SELECT w0, min(vec_id) AS rep FROM dct GROUP BY w0")


def lsh_key_sql(h: str, positions) -> str:
    k = len(positions)
    return " | ".join(f"({hex_bit(h, p)} << {k - 1 - j})" for j, p in enumerate(positions))


LSH_TABLES, LSH_BITS = 15, 20
cte("buckets", ("reps",), "\nUNION ALL\n".join(
    f"SELECT {i} AS table_idx, CAST({lsh_key_sql('perceptual_hash', pos)} AS BIGINT) AS bucket_key, rep AS id FROM reps"
    for i, pos in enumerate(lsh_positions(LSH_TABLES, LSH_BITS, 256))))
cte("lsh_cands", ("buckets",), """
SELECT DISTINCT a.id AS src, b.id AS dst FROM buckets a JOIN buckets b
  ON a.table_idx = b.table_idx AND a.bucket_key = b.bucket_key AND a.id < b.id""")


def with_ctes(*names: str) -> str:
    """``WITH [RECURSIVE] ...`` holding ``names`` and their dependencies, in order."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts, recursive = [], False
    for n in order:
        body = CTES[n][1]
        if body.startswith("RECURSIVE:"):
            recursive = True
            parts.append(body[len("RECURSIVE:"):])
        else:
            parts.append(f"{n} AS ({body})")
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def perceptual_chain(sfx: str, cand_deps: tuple, cand_body: str, pairs: str = "exact") -> None:
    """Register cand/reps/copies/pairs/edges/reach/comp/groups CTEs suffixed ``sfx``.

    ``pairs='exact'``: every representative pair within T_TEXT (nested loop);
    ``pairs='lsh'``: only pairs colliding in one of the seeded LSH tables, verified.
    """
    c, r = f"cand{sfx}", f"reps{sfx}"
    cte(c, cand_deps, cand_body)
    cte(r, (c,), f"""
SELECT rep, perceptual_hash, {', '.join(hex_word('perceptual_hash', i) + f' AS w{i}' for i in range(4))}
FROM (SELECT perceptual_hash, min(id) AS rep FROM {c} GROUP BY perceptual_hash) r""")
    cte(f"copies{sfx}", (c, r), f"SELECT x.id, y.rep FROM {c} x JOIN {r} y USING (perceptual_hash) WHERE x.id <> y.rep")
    if pairs == "exact":
        cte(f"pairs{sfx}", (r,), f"""
SELECT a.rep AS src, b.rep AS dst FROM {r} a JOIN {r} b ON a.rep < b.rep WHERE {dist('a', 'b', 4)} <= {T_TEXT}""")
    else:
        keys = "\nUNION ALL\n".join(
            f"SELECT {i} AS table_idx, CAST({lsh_key_sql('perceptual_hash', pos)} AS BIGINT) AS bucket_key, rep AS id FROM {r}"
            for i, pos in enumerate(lsh_positions(LSH_TABLES, LSH_BITS, 256)))
        cte(f"buckets{sfx}", (r,), keys)
        cte(f"pairs{sfx}", (f"buckets{sfx}", r), f"""
SELECT DISTINCT p.src, p.dst FROM (
  SELECT a.id AS src, b.id AS dst FROM buckets{sfx} a JOIN buckets{sfx} b
    ON a.table_idx = b.table_idx AND a.bucket_key = b.bucket_key AND a.id < b.id) p
JOIN {r} a ON a.rep = p.src JOIN {r} b ON b.rep = p.dst WHERE {dist('a', 'b', 4)} <= {T_TEXT}""")
    cte(f"edges{sfx}", (f"pairs{sfx}", f"copies{sfx}"), f"""
SELECT src AS a, dst AS b FROM pairs{sfx} UNION ALL SELECT dst, src FROM pairs{sfx}
UNION ALL SELECT id, rep FROM copies{sfx} UNION ALL SELECT rep, id FROM copies{sfx}""")
    CTES[f"reach{sfx}"] = ((f"edges{sfx}",), f"RECURSIVE:reach{sfx}(id, c) AS (SELECT a, a FROM edges{sfx} UNION "
                                           f"SELECT e.b, r.c FROM reach{sfx} r JOIN edges{sfx} e ON e.a = r.id)")
    cte(f"comp{sfx}", (f"reach{sfx}",), f"SELECT id, min(c) AS component FROM reach{sfx} GROUP BY id")
    cte(f"pm{sfx}", (c, f"comp{sfx}"), f"SELECT x.*, y.component FROM {c} x JOIN comp{sfx} y USING (id)")
    cte(f"pfirst{sfx}", (f"pm{sfx}",), f"SELECT component, min(path) AS first_path FROM pm{sfx} GROUP BY component")
    cte(f"perc_members{sfx}", (f"pm{sfx}", f"pfirst{sfx}"), f"""
SELECT {_MEMBER}, 'perceptual' AS match_type, CAST(component AS VARCHAR) AS gkey, pfirst{sfx}.first_path, 1 AS t
FROM pm{sfx} JOIN pfirst{sfx} USING (component)""")


# perceptual_only: every valid row with a fingerprint, nothing excluded
perceptual_chain("_po", ("valid",), "SELECT * FROM valid WHERE perceptual_hash IS NOT NULL")
cte("groups_po", ("perc_members_po",), ranked("perc_members_po"))
# whole dataflow with the LSH strategy forced
perceptual_chain("_lsh", ("cand",), "SELECT * FROM cand", pairs="lsh")
cte("all_members_lsh", ("exact_members", "perc_members_lsh"),
    "SELECT * FROM exact_members UNION ALL SELECT * FROM perc_members_lsh")
cte("groups_lsh", ("all_members_lsh",), ranked("all_members_lsh"))
