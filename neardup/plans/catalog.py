"""Registered queries: one Spark plan and (where SQL can say it) one DuckDB SQL each.

Every query reads the driver tables of ``sf_dir`` whole. Keys follow the operator
inventory; several operators share a query when one plan exercises them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from neardup import constants as C
from neardup.functions.fingerprint import simhash_words
from neardup.functions.scalars import (extension, format_number, format_rank, format_size,
                                       hex_to_words, words_to_hex)
from neardup.operators import actions as ACT, report as REP, selection as SEL, store as ST
from neardup.operators.bucket_store import BucketStore
from neardup.operators.exact import exact_hash_groups
from neardup.operators.hamming import (band_pairs, collapse, lsh_buckets, lsh_pairs, lsh_positions,
                                       pigeonhole_plan)
from neardup.operators.pigeonhole import general_plan
from neardup.plans import sql as S
from neardup.plans.dataflow import GROUP_COLUMNS, find_duplicates, perceptual_candidates, perceptual_components
from neardup.sources import fixtures as FX
from neardup.session import cut_lineage, ensure_checkpoint_dir
from neardup.sources.tables import read_table, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# shared Spark pieces
# ---------------------------------------------------------------------------

def _valid(spark, d, fp=True) -> DataFrame:
    return FX.manifest_docs(spark, d, with_fp=fp).where(F.col("error").isNull())


def _groups_exact(spark, d) -> DataFrame:
    return find_duplicates(FX.manifest_docs(spark, d, with_fp=False), mode="exact_only")


def _groups_all(spark, d, mode="both") -> DataFrame:
    return find_duplicates(FX.manifest_docs(spark, d), threshold=S.T_TEXT, mode=mode)


def _cand(spark, d) -> DataFrame:
    """Near-duplicate candidates; the fingerprints are computed once and pinned first.

    Pinning before any filter on ``fp`` matters: Catalyst would push such a filter
    below the parallelising repartition and evaluate the UDF twice.
    """
    v = cut_lineage(_valid(spark, d).select("id", "path", "file_hash", "fp"))
    return perceptual_candidates(v, exact_hash_groups(v))


def _text_reps(spark, d):
    return collapse(_cand(spark, d))


def _vec_reps(spark, d):
    v = cut_lineage(FX.fp_vec(spark, d).select(F.col("vec_id").alias("id"), "fp"))
    return collapse(v)


_G = ", ".join(GROUP_COLUMNS)

# ---------------------------------------------------------------------------
# sources, projections, scalars
# ---------------------------------------------------------------------------

_MANIFEST_COLS = ["id", "path", "mtime_s", "file_size", "width", "height", "pixel_count", "bit_depth",
                  "format", "file_hash", "error", "quality_score"]


@register("analyze_manifest", S.with_ctes("m_failing") + f"SELECT {', '.join(_MANIFEST_COLS)} FROM m_failing")
def analyze_manifest(spark, d):
    m = FX.manifest_docs(spark, d, with_fp=False, failing=True).withColumn("mtime_s", F.unix_seconds("mtime"))
    return m.select(*_MANIFEST_COLS)


@register("quality_score", S.with_ctes("m") + f"""
SELECT id, {S.EXT_SQL} AS ext, {S._rank_case(S.EXT_SQL)} AS format_rank, quality_score FROM m WHERE error IS NULL""")
def quality_score(spark, d):
    v = _valid(spark, d, fp=False)
    return v.select("id", extension("path").alias("ext"), format_rank(extension("path")).alias("format_rank"),
                    "quality_score")


@register("manifest_projection", S.with_ctes("m_failing") + f"""
SELECT path,
       regexp_extract(path, '[^/]*$', 0) AS filename,
       CASE WHEN strpos(path, '/') = 0 THEN '' WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '/'
            ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS directory,
       file_size, {S.size_sql('file_size')} AS file_size_formatted,
       width, height, CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR) AS resolution,
       pixel_count, ((pixel_count + 5000) // 10000) / 100.0::DOUBLE AS megapixels, format,
       {S.one_decimal('quality_score')} AS quality_1dp, error
FROM m_failing""")
def manifest_projection(spark, d):
    return REP.manifest_projection(FX.manifest_docs(spark, d, with_fp=False, failing=True))


@register("format_size", S.with_ctes("m") + f"""
SELECT id, {S.size_sql('file_size // 1024')} AS size_b, {S.size_sql('file_size')} AS size_kb,
       {S.size_sql('file_size * 1024')} AS size_mb, {S.size_sql('file_size * 1048576')} AS size_gb,
       {S.size_sql('file_size * 1073741824')} AS size_tb
FROM m""")
def format_size_q(spark, d):
    m = FX.manifest_docs(spark, d, with_fp=False)
    fs = F.col("file_size")
    return m.select("id", format_size(F.expr("file_size div 1024")).alias("size_b"),
                    format_size(fs).alias("size_kb"), format_size(fs * 1024).alias("size_mb"),
                    format_size(fs * 1048576).alias("size_gb"), format_size(fs * 1073741824).alias("size_tb"))


@register("format_numbers", S.with_ctes("m") + """
SELECT id, format('{:,}', pixel_count) AS pixels_fmt, format('{:,}', file_size) AS size_fmt FROM m""")
def format_numbers(spark, d):
    m = FX.manifest_docs(spark, d, with_fp=False)
    return m.select("id", format_number("pixel_count").alias("pixels_fmt"),
                    format_number("file_size").alias("size_fmt"))


@register("error_split", S.with_ctes("m_failing") + """
SELECT CASE WHEN error IS NULL THEN 'valid' ELSE 'error' END AS status, count(*) AS n FROM m_failing GROUP BY 1""")
def error_split(spark, d):
    m = FX.manifest_docs(spark, d, with_fp=False, failing=True)
    return (m.groupBy(F.when(F.col("error").isNull(), "valid").otherwise("error").alias("status"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


_SCAN_EXTS = [e for e in C.IMAGE_EXTENSIONS if e not in C.CODEC_EXTENSIONS]


@register("scan_by_extension", S.with_ctes("m") + f"""
SELECT DISTINCT path, {S.EXT_SQL} AS ext FROM m WHERE {S.EXT_SQL} IN ({', '.join(f"'{e}'" for e in _SCAN_EXTS)})""")
def scan_by_extension(spark, d):
    # every path is listed twice: by the manifest and by today's listing
    listed = FX.manifest_docs(spark, d, with_fp=False).select("path").unionByName(FX.listing_now(spark, d).select("path"))
    from neardup.sources.files import keep_image_paths
    return keep_image_paths(listed).select("path", extension("path").alias("ext"))


@register("content_hash", """
SELECT page_id, url, sha256(html) AS sha256, md5(html) AS md5, sha1(html) AS sha1 FROM pages""")
def content_hash(spark, d):
    p = read_table(spark, d, "pages")
    return p.select("page_id", "url", F.sha2("html", 256).alias("sha256"), F.md5("html").alias("md5"),
                    F.sha1("html").alias("sha1"))


@register("text_fingerprint", S.with_ctes("fpx") + """
SELECT d.doc_id, fpx.perceptual_hash FROM documents d LEFT JOIN fpx USING (doc_id)""")
def text_fingerprint(spark, d):
    return FX.fp_docs(spark, d).select("doc_id", "perceptual_hash")


@register("vector_fingerprint", S.with_ctes("vfp") + """
SELECT e.vec_id, lpad(lower(hex(vfp.w0)), 16, '0') AS vec_hash FROM embeddings e LEFT JOIN vfp USING (vec_id)""")
def vector_fingerprint_q(spark, d):
    return FX.fp_vec(spark, d).select("vec_id", "vec_hash")


@register("dct_hash", S.with_ctes("dct") + """
SELECT e.vec_id, lpad(lower(hex(dct.w0)), 16, '0') AS dct_hash FROM embeddings e LEFT JOIN dct USING (vec_id)""")
def dct_hash_q(spark, d):
    """The embeddings as gray pictures of 8 x 8 and their DCT hash, in column arithmetic."""
    return FX.dct_vec(spark, d).select("vec_id", words_to_hex("fp", 1).alias("dct_hash"))


@register("fingerprint_parse", S.with_ctes("fpx") + f"""
SELECT doc_id, {', '.join(S.signed(S.hex_word('perceptual_hash', i)) + f' AS w{i}' for i in range(4))},
       upper(perceptual_hash) AS upper_hash,
       'g' || substr(perceptual_hash, 2) AS broken_hash
FROM fpx""")
def fingerprint_parse(spark, d):
    fp = cut_lineage(FX.fp_docs(spark, d)).where(F.col("fp").isNotNull())   # pin before filtering on fp
    up = F.upper("perceptual_hash")
    broken = F.concat(F.lit("g"), F.substring("perceptual_hash", 2, 63))
    w = hex_to_words(up)
    bad = hex_to_words(broken)
    out = fp.select("doc_id", *[w[i].alias(f"w{i}") for i in range(4)], up.alias("upper_hash"),
                    broken.alias("broken_hash"), bad.alias("_bad"))
    # the round trip must hold and a bad digit must give NULL, not zeros
    out = out.where(F.col("_bad").isNull() & (words_to_hex(F.array(*[F.col(f"w{i}") for i in range(4)]), 4)
                                              == F.lower("upper_hash")))
    return out.drop("_bad")


# ---------------------------------------------------------------------------
# exact groups, selection, aggregates on groups
# ---------------------------------------------------------------------------

@register("exact_groups", S.with_ctes("groups_exact") + f"""
SELECT {_G.replace('is_best', 'member_rank = 1 AS is_best')} FROM groups_exact""")
def exact_groups(spark, d):
    return _groups_exact(spark, d).select(*GROUP_COLUMNS)


_STRAT_SQL = {
    "quality": "quality_score DESC, path",
    "largest": "file_size DESC, path",
    "smallest": "file_size ASC, path",
    "newest": "CASE WHEN id % 5 <> 0 THEN mtime_s END DESC NULLS LAST, path",
    "oldest": "CASE WHEN id % 5 <> 0 THEN mtime_s END ASC NULLS LAST, path",
}


def _select_query(strategy: str):
    sql = S.with_ctes("groups_exact") + f"""
SELECT group_id, path, CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY {_STRAT_SQL[strategy]}) = 1
       THEN 'keep' ELSE 'delete' END AS decision FROM groups_exact"""

    def q(spark, d):
        # some members have no known time, so both orders by time meet NULLs
        g = _groups_exact(spark, d).withColumn("mtime", F.when(F.col("id") % 5 != 0, F.col("mtime")))
        return SEL.selections(g, strategy)

    register(f"select_{strategy}", sql)(q)


for _s in C.STRATEGIES:
    _select_query(_s)


@register("best_image", S.with_ctes("groups_exact") + """
SELECT group_id, path AS best_path, quality_score AS best_quality FROM groups_exact WHERE member_rank = 1""")
def best_image(spark, d):
    return SEL.best_per_group(_groups_exact(spark, d))


@register("duplicate_members", S.with_ctes("groups_exact") + """
SELECT group_id, path, file_size FROM groups_exact WHERE member_rank > 1""")
def duplicate_members(spark, d):
    return _groups_exact(spark, d).where(~F.col("is_best")).select("group_id", "path", "file_size")


@register("potential_savings", S.with_ctes("groups_exact") + f"""
SELECT group_id, CAST(sum(CASE WHEN member_rank > 1 THEN file_size ELSE 0 END) AS BIGINT) AS potential_savings,
       {S.size_sql('sum(CASE WHEN member_rank > 1 THEN file_size ELSE 0 END)')} AS potential_savings_formatted
FROM groups_exact GROUP BY group_id""")
def potential_savings(spark, d):
    g = _groups_exact(spark, d)
    s = g.groupBy("group_id").agg(
        F.sum(F.when(~F.col("is_best"), F.col("file_size")).otherwise(0)).cast("bigint").alias("potential_savings"))
    return s.withColumn("potential_savings_formatted", format_size("potential_savings"))


def _stats_sql(groups_cte: str) -> str:
    per = f"""
SELECT match_type, CAST(sum(CASE WHEN member_rank > 1 THEN 1 ELSE 0 END) AS BIGINT) AS total_duplicates,
       CAST(count(DISTINCT group_id) AS BIGINT) AS total_groups,
       CAST(sum(CASE WHEN member_rank > 1 THEN file_size ELSE 0 END) AS BIGINT) AS total_waste
FROM {groups_cte} GROUP BY match_type"""
    return f"""
SELECT *, {S.size_sql('total_waste')} AS total_waste_formatted FROM (
  {per}
  UNION ALL
  SELECT 'total', CAST(sum(total_duplicates) AS BIGINT), CAST(sum(total_groups) AS BIGINT),
         CAST(sum(total_waste) AS BIGINT) FROM ({per}) p) s"""


@register("report_summary", S.with_ctes("groups_all") + _stats_sql("groups_all"))
def report_summary(spark, d):
    return REP.group_stats(_groups_all(spark, d))


@register("report_summary_newest", S.with_ctes("groups_all") + _stats_sql("groups_all"))
def report_summary_newest(spark, d):
    """Waste leaves out the best by quality also where the newest is selected."""
    return REP.group_stats(find_duplicates(FX.manifest_docs(spark, d), threshold=S.T_TEXT, strategy="newest"))


@register("scan_summary", S.with_ctes("groups_all", "m") + """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM m) AS total_files,
       (SELECT CAST(count(error) AS BIGINT) FROM m) AS errors,
       CAST(count(DISTINCT CASE WHEN match_type = 'exact' THEN group_id END) AS BIGINT) AS exact_groups,
       CAST(count(DISTINCT CASE WHEN match_type = 'perceptual' THEN group_id END) AS BIGINT) AS similar_groups,
       CAST(count(*) FILTER (WHERE match_type = 'exact') AS BIGINT) AS exact_files,
       CAST(count(*) FILTER (WHERE match_type = 'perceptual') AS BIGINT) AS similar_files,
       CAST(count(DISTINCT group_id) AS BIGINT) AS total_groups
FROM groups_all""")
def scan_summary(spark, d):
    m = FX.manifest_docs(spark, d, with_fp=False)
    return REP.scan_summary(m, _groups_all(spark, d))


@register("report_rows", S.with_ctes("groups_all") + f"""
SELECT group_id, 0 AS seq, printf('Group %d (%d files):', group_id, count(*)) AS line FROM groups_all GROUP BY group_id
UNION ALL
SELECT group_id, member_rank * 2 - 1, CASE WHEN member_rank = 1 THEN '  [KEEP] ' ELSE '  [DUPE] ' END || path FROM groups_all
UNION ALL
SELECT group_id, member_rank * 2, '         ' || CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR) || ' | '
       || {S.size_sql('file_size')} || ' | Score: ' || {S.one_decimal('quality_score')} FROM groups_all""")
def report_rows(spark, d):
    return REP.report_lines(_groups_all(spark, d))


_RULE, _THIN = "=" * REP.RULE, "-" * REP.RULE
_FOUND = "SELECT 0, 0, {k}, '{kind} duplicates found: ' || count(*) FILTER (WHERE member_rank > 1) || ' files in ' || " \
         "count(DISTINCT group_id) || ' groups' FROM groups_all WHERE match_type = '{match}'"


@register("report_document", S.with_ctes("groups_all") + f""", n AS (
SELECT *, dense_rank() OVER (PARTITION BY match_type ORDER BY group_id) AS i, count(*) OVER (PARTITION BY group_id) AS files,
       CASE WHEN match_type = 'exact' THEN 1 ELSE 2 END AS section FROM groups_all),
l(section, grp, seq, line) AS (
SELECT 0, 0, unnest([1, 2, 3, 4, 5]), unnest(['', '{_RULE}', 'DUPLICATE IMAGE REPORT', '{_RULE}', ''])
UNION ALL {_FOUND.format(k=6, kind="Exact", match="exact")}
UNION ALL {_FOUND.format(k=7, kind="Perceptual", match="perceptual")}
UNION ALL SELECT section, 0, unnest([1, 2, 3, 4]), unnest(['', '{_THIN}', CASE WHEN section = 1 THEN '{REP.SECTIONS[0][1]}' ELSE '{REP.SECTIONS[1][1]}' END, '{_THIN}'])
          FROM (SELECT DISTINCT section FROM n)
UNION ALL SELECT section, i, -1, '' FROM n WHERE member_rank = 1
UNION ALL SELECT section, i, 0, printf('Group %d (%d files):', i, files) FROM n WHERE member_rank = 1
UNION ALL SELECT section, i, 2 * member_rank - 1, CASE WHEN member_rank = 1 THEN '  [KEEP] ' ELSE '  [DUPE] ' END || path FROM n
UNION ALL SELECT section, i, 2 * member_rank, '         ' || CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR) || ' | '
       || {S.size_sql('file_size')} || ' | Score: ' || {S.one_decimal('quality_score')} FROM n
UNION ALL SELECT 3, 0, unnest([1, 2, 4]), unnest(['', '{_RULE}', '{_RULE}'])
UNION ALL SELECT 3, 0, 3, 'Total space recoverable: ' || {S.size_sql('waste')}
          FROM (SELECT CAST(coalesce(sum(file_size) FILTER (WHERE member_rank > 1), 0) AS BIGINT) AS waste FROM groups_all) w)
SELECT row_number() OVER (ORDER BY section, grp, seq) AS line_no, line FROM l""")
def report_document(spark, d):
    """The text report as the original prints it, each line with its number."""
    return REP.report_document(_groups_all(spark, d))


@register("export_rows", S.with_ctes("groups_all") + f"""
SELECT group_id, match_type, CASE WHEN member_rank = 1 THEN 'keep' ELSE 'duplicate' END AS status, path,
       width, height, file_size, {S.one_decimal('quality_score')} AS quality_score FROM groups_all""")
def export_rows(spark, d):
    return REP.export_rows(_groups_all(spark, d))


@register("export_rows_newest", S.with_ctes("groups_all") + f"""
SELECT group_id, match_type, CASE WHEN member_rank = 1 THEN 'keep' ELSE 'duplicate' END AS status, path,
       width, height, file_size, {S.one_decimal('quality_score')} AS quality_score FROM groups_all""")
def export_rows_newest(spark, d):
    """The status follows quality also where the newest is selected."""
    return REP.export_rows(find_duplicates(FX.manifest_docs(spark, d), threshold=S.T_TEXT, strategy="newest"))


@register("groups_json", S.with_ctes("groups_exact") + f"""
SELECT g.group_id, p.page, g.match_type, g.image_count, p.member_paths, g.best_path, g.selected_keep,
       g.potential_savings
FROM (SELECT group_id, match_type, CAST(count(*) AS BIGINT) AS image_count,
             max(CASE WHEN member_rank = 1 THEN path END) AS best_path,
             max(CASE WHEN member_rank = 1 THEN path END) AS selected_keep,
             CAST(sum(CASE WHEN member_rank > 1 THEN file_size ELSE 0 END) AS BIGINT) AS potential_savings
      FROM groups_exact GROUP BY group_id, match_type) g
JOIN (SELECT group_id, CAST((member_rank - 1) // {REP.GROUP_PAGE_SIZE} AS INTEGER) AS page,
             string_agg(path, '|' ORDER BY member_rank) AS member_paths
      FROM groups_exact GROUP BY 1, 2) p USING (group_id)""")
def groups_json(spark, d):
    nested = REP.groups_nested(_groups_exact(spark, d))
    return nested.select("group_id", "page", "match_type", F.col("image_count").cast("bigint").alias("image_count"),
                         F.array_join(F.transform("images", lambda x: x["path"]), "|").alias("member_paths"),
                         "best_path", "selected_keep", "potential_savings")


_NESTED_SCHEMA = ("group_id BIGINT, page INT, match_type STRING, image_count BIGINT, "
                  "images ARRAY<STRUCT<rank: INT, path: STRING, file_size: BIGINT, quality_score: DOUBLE>>, "
                  "best_path STRING, selected_keep STRING")


@register("groups_json_roundtrip", S.with_ctes("groups_exact") + """
SELECT group_id, match_type, path, member_rank, file_size FROM groups_exact""")
def groups_json_roundtrip(spark, d):
    nested = REP.groups_nested(_groups_exact(spark, d))
    js = nested.select(F.to_json(F.struct(*nested.columns)).alias("doc"))
    back = js.select(F.from_json("doc", _NESTED_SCHEMA).alias("g")).select("g.*")
    return back.select("group_id", "match_type", F.explode("images").alias("im")).select(
        "group_id", "match_type", F.col("im.path").alias("path"), F.col("im.rank").alias("member_rank"),
        F.col("im.file_size").alias("file_size"))


@register("apply_user_choice", S.with_ctes("groups_exact") + """
SELECT g.group_id, coalesce(min(CASE WHEN l.quality = 1 THEN g.path END),
                            max(CASE WHEN g.member_rank = 1 THEN g.path END)) AS keep_path
FROM groups_exact g LEFT JOIN labels l ON l.doc_id = g.id GROUP BY g.group_id""")
def apply_user_choice(spark, d):
    g = _groups_exact(spark, d)
    labels = read_table(spark, d, "labels").where(F.col("quality") == 1).select(F.col("doc_id").alias("id"))
    choices = (g.join(labels, "id", "left_semi").groupBy("group_id")
               .agg(F.min("path").alias("selected_keep")))
    return SEL.apply_user_choice(g, choices)


@register("action_plan", S.with_ctes("groups_exact") + """
SELECT g.group_id, g.path, 'hardlink' AS action, k.path AS target, k.path AS keeper, g.file_size AS bytes
FROM groups_exact g JOIN groups_exact k ON k.group_id = g.group_id AND k.member_rank = 1
WHERE g.member_rank > 1""")
def action_plan(spark, d):
    return ACT.action_plan(_groups_exact(spark, d), "hardlink")


# basenames that repeat, some of them of the form that numbering gives
_COPY_PATH_SQL = ("'/' || CAST(id AS VARCHAR) || '/copy' || CASE WHEN id % 3 = 0 THEN '_' || CAST(id % 7 AS VARCHAR) ELSE '' END "
                  "|| CASE WHEN id % 2 = 0 THEN '.png' ELSE '' END")
_NUMBERED = r"'^(.+)_([1-9][0-9]*)(\.[^.]*)?$'"


@register("action_plan_move", S.with_ctes("groups_exact") + f""",
c AS (SELECT * REPLACE ({_COPY_PATH_SQL} AS path) FROM groups_exact),
x AS (SELECT g.*, k.path AS keeper, regexp_extract(g.path, '[^/]*$', 0) AS name,
             row_number() OVER (PARTITION BY regexp_extract(g.path, '[^/]*$', 0)
                                ORDER BY g.group_id, g.member_rank, g.path) AS k
      FROM c g JOIN c k ON k.group_id = g.group_id AND k.member_rank = 1
      WHERE g.member_rank > 1),
used AS (SELECT DISTINCT regexp_extract(name, {_NUMBERED}, 1) || regexp_extract(name, {_NUMBERED}, 3) AS name,
                CAST(regexp_extract(name, {_NUMBERED}, 2) AS BIGINT) AS number
         FROM x WHERE regexp_matches(name, {_NUMBERED})),
tried AS (SELECT name, unnest(range(1, n + 1 + (SELECT count(*) FROM used))) AS number
          FROM (SELECT name, max(k) AS n FROM x GROUP BY name) y),
free AS (SELECT name, number, row_number() OVER (PARTITION BY name ORDER BY number) AS r
         FROM tried t WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.name = t.name AND u.number = t.number))
SELECT x.group_id, x.path, 'move' AS action,
       '/trash/' || CASE WHEN x.k = 1 THEN x.name
                         ELSE regexp_extract(x.name, '^(.+?)(\\.[^.]*)?$', 1) || '_' || CAST(f.number AS VARCHAR)
                              || regexp_extract(x.name, '^(.+?)(\\.[^.]*)?$', 2) END AS target,
       x.keeper, x.file_size AS bytes
FROM x LEFT JOIN free f ON f.name = x.name AND f.r = x.k - 1""")
def action_plan_move(spark, d):
    g = _groups_exact(spark, d).withColumn("path", F.concat(
        F.lit("/"), F.col("id").cast("string"), F.lit("/copy"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("_"), (F.col("id") % 7).cast("string"))).otherwise(F.lit("")),
        F.when(F.col("id") % 2 == 0, F.lit(".png")).otherwise(F.lit(""))))
    return ACT.action_plan(g, "move", "/trash")


@register("action_plan_summary", S.with_ctes("groups_exact") + """,
gone AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
p AS (SELECT g.file_size, g.id NOT IN (SELECT doc_id FROM gone) AS there, k.id NOT IN (SELECT doc_id FROM gone) AS keeper
      FROM groups_exact g JOIN groups_exact k ON k.group_id = g.group_id AND k.member_rank = 1 WHERE g.member_rank > 1)
SELECT CAST(count(*) FILTER (WHERE there AND keeper) AS BIGINT) AS processed,
       CAST(count(*) FILTER (WHERE NOT there) AS BIGINT) AS skipped,
       CAST(count(*) FILTER (WHERE there AND NOT keeper) AS BIGINT) AS errors,
       CAST(coalesce(sum(file_size) FILTER (WHERE there AND keeper), 0) AS BIGINT) AS space_saved
FROM p""")
def action_plan_summary(spark, d):
    """Files labelled as poor were removed since the scan."""
    g = _groups_exact(spark, d)
    gone = read_table(spark, d, "labels").where(F.col("quality") == 0).select(F.col("doc_id").alias("id"))
    listing = FX.manifest_docs(spark, d, with_fp=False).select("id", "path").join(gone, "id", "left_anti")
    return ACT.action_summary(ACT.action_plan(g, "hardlink"), listing)


# ---------------------------------------------------------------------------
# near duplicates: candidates, pairs, LSH, components, groups
# ---------------------------------------------------------------------------

@register("perceptual_candidates", S.with_ctes("cand") + "SELECT id, path FROM cand")
def perceptual_candidates_q(spark, d):
    return _cand(spark, d).select("id", "path")


_PAIRS_SQL = S.with_ctes("pairs") + "SELECT src, dst, distance FROM pairs"


@register("hamming_pairs_exact", _PAIRS_SQL)
def hamming_pairs_exact(spark, d):
    reps, _ = _text_reps(spark, d)
    return band_pairs(reps, 4, general_plan(reps, reps.count(), 256, S.T_TEXT))


@register("hamming_pairs_bands", _PAIRS_SQL)
def hamming_pairs_bands(spark, d):
    reps, _ = _text_reps(spark, d)
    return band_pairs(reps, 4, pigeonhole_plan(256, S.T_TEXT))


@register("vector_pairs", S.with_ctes("vpairs") + "SELECT src, dst, distance FROM vpairs")
def vector_pairs(spark, d):
    reps, _ = _vec_reps(spark, d)
    return band_pairs(reps, 1, general_plan(reps, reps.count(), 64, S.T_VEC))


@register("dct_pairs", S.with_ctes("dct_reps") + f"""
SELECT a.rep AS src, b.rep AS dst, CAST({S.dist('a', 'b', 1)} AS INTEGER) AS distance
FROM dct_reps a JOIN dct_reps b ON a.rep < b.rep WHERE {S.dist('a', 'b', 1)} <= {S.T_VEC}""")
def dct_pairs(spark, d):
    """Pictures whose DCT hashes differ in few bits: the image path with the exact band join."""
    reps, _ = collapse(cut_lineage(FX.dct_vec(spark, d).select(F.col("vec_id").alias("id"), "fp")))
    return band_pairs(reps, 1, general_plan(reps, reps.count(), 64, S.T_VEC))


_LSH_POS = lsh_positions(S.LSH_TABLES, S.LSH_BITS, 256)


@register("lsh_bucket_keys", S.with_ctes("buckets") + "SELECT table_idx, bucket_key, id FROM buckets")
def lsh_bucket_keys(spark, d):
    reps, _ = _text_reps(spark, d)
    return lsh_buckets(reps, 4, _LSH_POS).select(F.col("table_idx").cast("int"), "bucket_key", "id")


@register("lsh_candidate_pairs", S.with_ctes("lsh_cands") + "SELECT src, dst FROM lsh_cands")
def lsh_candidate_pairs(spark, d):
    reps, _ = _text_reps(spark, d)
    return lsh_pairs(reps, 4, _LSH_POS, None).select("src", "dst")


@register("lsh_verified_pairs", S.with_ctes("lsh_cands", "reps") + f"""
SELECT c.src, c.dst, CAST({S.dist('a', 'b', 4)} AS INTEGER) AS distance
FROM lsh_cands c JOIN reps a ON a.rep = c.src JOIN reps b ON b.rep = c.dst
WHERE {S.dist('a', 'b', 4)} <= {S.T_TEXT}""")
def lsh_verified_pairs(spark, d):
    reps, _ = _text_reps(spark, d)
    return lsh_pairs(reps, 4, _LSH_POS, S.T_TEXT)


def _probe_sql() -> str:
    keys = "\nUNION ALL\n".join(
        f"SELECT {i} AS table_idx, CAST({S.lsh_key_sql('perceptual_hash', pos)} AS BIGINT) AS bucket_key, item_id FROM probe"
        for i, pos in enumerate(_LSH_POS))
    tok = S.CTES["tok"][1].replace("doc_id", "item_id").replace("FROM documents", "FROM benchmark")
    body = S.with_ctes("buckets")
    body = body.replace("WITH ", "WITH btok AS (" + tok + "),\n"
                        "btokh AS (SELECT item_id, sha256(tok) AS h FROM btok),\n"
                        "btokn AS (SELECT item_id, count(*) AS n FROM btokh GROUP BY item_id),\n"
                        "bvotes AS (SELECT t.item_id, b.pos, sum(((strpos('0123456789abcdef', substr(t.h, b.pos // 4 + 1, 1)) - 1) >> (3 - b.pos % 4)) & 1) AS ones "
                        "FROM btokh t CROSS JOIN range(256) AS b(pos) GROUP BY t.item_id, b.pos),\n"
                        "probe AS (SELECT item_id, string_agg(digit, '' ORDER BY nib) AS perceptual_hash FROM ("
                        "SELECT v.item_id, v.pos // 4 AS nib, substr('0123456789abcdef', CAST(sum(CASE WHEN v.ones * 2 > n.n THEN 1 ELSE 0 END << (3 - v.pos % 4)) AS INTEGER) + 1, 1) AS digit "
                        "FROM bvotes v JOIN btokn n USING (item_id) GROUP BY v.item_id, v.pos // 4) q GROUP BY item_id),\n"
                        f"pkeys AS ({keys}),\n", 1)
    return body + """
SELECT DISTINCT p.item_id, b.id AS doc_id FROM pkeys p JOIN buckets b
  ON p.table_idx = b.table_idx AND p.bucket_key = b.bucket_key"""


@register("lsh_probe", _probe_sql())
def lsh_probe(spark, d):
    from neardup.operators.hamming import lsh_probe as probe_join
    reps, _ = _text_reps(spark, d)
    bench = spread(read_table(spark, d, "benchmark"))
    # no filter on fp here: rows without tokens have a NULL fp and match no bucket
    probes = cut_lineage(bench.select(F.col("item_id").alias("rep"), simhash_words("text").alias("fp")))
    return probe_join(probes, reps, 4, _LSH_POS).select(F.col("probe").alias("item_id"), F.col("id").alias("doc_id"))


@register("lsh_probe_self", S.with_ctes("lsh_cands") + """
SELECT src AS probe, dst AS id FROM lsh_cands UNION ALL SELECT dst, src FROM lsh_cands""")
def lsh_probe_self(spark, d):
    """Every document looks for the others in the index of all documents."""
    from neardup.operators.hamming import lsh_probe as probe_join
    reps, _ = _text_reps(spark, d)
    return probe_join(reps, reps, 4, _LSH_POS, exclude_self=True).select("probe", "id")


@register("lsh_index_stats", S.with_ctes("buckets") + f"""
SELECT {S.LSH_TABLES} AS num_tables, {S.LSH_BITS} AS bits_per_table,
       (SELECT CAST(count(DISTINCT id) AS BIGINT) FROM buckets) AS total_items,
       CAST(count(*) AS BIGINT) AS non_empty_buckets,
       round(sum(n)::DOUBLE / greatest(1, count(*)), 6) AS avg_bucket_size
FROM (SELECT table_idx, bucket_key, count(*) AS n FROM buckets GROUP BY 1, 2) b""")
def lsh_index_stats(spark, d):
    from neardup.operators.hamming import lsh_index_stats as stats
    reps, _ = _text_reps(spark, d)
    return stats(lsh_buckets(reps, 4, _LSH_POS), S.LSH_TABLES, S.LSH_BITS)


@register("lsh_candidate_estimate", S.with_ctes("buckets") + """
SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) AS estimated_pairs
FROM (SELECT table_idx, bucket_key, count(*) AS n FROM buckets GROUP BY 1, 2) b""")
def lsh_candidate_estimate(spark, d):
    from neardup.operators.hamming import lsh_estimate
    reps, _ = _text_reps(spark, d)
    return lsh_estimate(lsh_buckets(reps, 4, _LSH_POS))


@register("lsh_run_stats", S.with_ctes("lsh_cands", "reps") + f"""
SELECT n AS total_images, 2 * c AS total_candidates, c AS total_comparisons, f AS duplicate_pairs_found,
       round(CASE WHEN n = 0 THEN 0.0 ELSE 2.0 * c / n END, 6) AS avg_candidates_per_image,
       round(CASE WHEN n * (n - 1) // 2 = 0 THEN 0.0 ELSE 1.0 - c / (n * (n - 1) // 2)::DOUBLE END, 6) AS reduction_ratio
FROM (SELECT (SELECT CAST(count(*) AS BIGINT) FROM reps) AS n,
             (SELECT CAST(count(*) AS BIGINT) FROM lsh_cands) AS c,
             (SELECT CAST(count(*) AS BIGINT) FROM lsh_cands l JOIN reps a ON a.rep = l.src JOIN reps b ON b.rep = l.dst
              WHERE {S.dist('a', 'b', 4)} <= {S.T_TEXT}) AS f) s""")
def lsh_run_stats(spark, d):
    from neardup.operators.hamming import lsh_run_stats as run_stats
    reps, _ = _text_reps(spark, d)
    return run_stats(reps, lsh_pairs(reps, 4, _LSH_POS, None), S.T_TEXT)


def _sizes_sql() -> str:
    return S.with_ctes("m", "cand") + """, sizes AS (
  SELECT 'documents' AS collection, CAST(count(*) AS BIGINT) AS n FROM m
  UNION ALL SELECT 'candidates', CAST(count(*) AS BIGINT) FROM cand
  UNION ALL SELECT 'embeddings', CAST(count(*) AS BIGINT) FROM embeddings)"""


def _tier_sql(n: str) -> tuple[str, str]:
    t = "CASE " + " ".join(f"WHEN {n} < {b} THEN {L}" for b, L, k in C.LSH_SIZE_TIERS if b) + \
        f" ELSE {C.LSH_SIZE_TIERS[-1][1]} END"
    k = "CASE " + " ".join(f"WHEN {n} < {b} THEN {kk}" for b, L, kk in C.LSH_SIZE_TIERS if b) + \
        f" ELSE {C.LSH_SIZE_TIERS[-1][2]} END"
    return t, k


@register("lsh_params", _sizes_sql() + f"""
SELECT collection, n, {_tier_sql('n')[0]} AS num_tables, {_tier_sql('n')[1]} AS bits_per_table FROM sizes""")
def lsh_params_q(spark, d):
    from neardup.operators.hamming import collection_sizes, lsh_param_columns
    return lsh_param_columns(collection_sizes(spark, d))


@register("lsh_cost_model", _sizes_sql() + f"""
SELECT collection, n, num_tables, bits_per_table, brute_force_comparisons, estimated_lsh_comparisons,
       round(1.0 - estimated_lsh_comparisons::DOUBLE / greatest(1, brute_force_comparisons), 6) AS estimated_reduction,
       round(brute_force_comparisons::DOUBLE / greatest(1, estimated_lsh_comparisons), 6) AS speedup_factor
FROM (SELECT *, CAST(n * (n - 1) // 2 AS BIGINT) AS brute_force_comparisons,
             CAST(floor(n * least(n - 1.0::DOUBLE, greatest(0.0::DOUBLE, greatest(0.0::DOUBLE, n::DOUBLE / pow(2.0::DOUBLE, bits_per_table) - 1.0::DOUBLE)
                  * num_tables * {C.LSH_OVERLAP_FACTOR}::DOUBLE)) / 2.0::DOUBLE) AS BIGINT) AS estimated_lsh_comparisons
      FROM (SELECT collection, n, {_tier_sql('n')[0]} AS num_tables, {_tier_sql('n')[1]} AS bits_per_table FROM sizes) t) c""")
def lsh_cost_model(spark, d):
    from neardup.operators.hamming import collection_sizes, lsh_cost_columns, lsh_param_columns
    return lsh_cost_columns(lsh_param_columns(collection_sizes(spark, d)))


@register("components", S.with_ctes("comp") + "SELECT id, component FROM comp")
def components(spark, d):
    return perceptual_components(_cand(spark, d), S.T_TEXT, 256)


@register("vector_components", (S.with_ctes("vpairs", "vcopies") + """, vedges AS (
  SELECT src AS a, dst AS b FROM vpairs UNION ALL SELECT dst, src FROM vpairs
  UNION ALL SELECT id, rep FROM vcopies UNION ALL SELECT rep, id FROM vcopies),
vreach(id, c) AS (SELECT a, a FROM vedges UNION SELECT e.b, r.c FROM vreach r JOIN vedges e ON e.a = r.id)
SELECT id, min(c) AS component FROM vreach GROUP BY id""").replace("WITH ", "WITH RECURSIVE ", 1))
def vector_components(spark, d):
    return perceptual_components(cut_lineage(FX.fp_vec(spark, d).select(F.col("vec_id").alias("id"), "fp")), S.T_VEC, 64)


@register("perceptual_groups", S.with_ctes("groups_all") + f"""
SELECT {_G.replace('is_best', 'member_rank = 1 AS is_best')} FROM groups_all WHERE match_type = 'perceptual'""")
def perceptual_groups(spark, d):
    return _groups_all(spark, d).where(F.col("match_type") == "perceptual").select(*GROUP_COLUMNS)


@register("find_duplicates", S.with_ctes("groups_all") + f"""
SELECT {_G.replace('is_best', 'member_rank = 1 AS is_best')} FROM groups_all""")
def find_duplicates_q(spark, d):
    return _groups_all(spark, d).select(*GROUP_COLUMNS)


# ---------------------------------------------------------------------------
# incremental store (B4 fixtures: an older store and today's listing)
# ---------------------------------------------------------------------------

def _store_listing(spark, d):
    return FX.store_old(spark, d), FX.listing_now(spark, d)


_HIT = "(s.path IS NOT NULL)"
_JOIN = "listing l LEFT JOIN store s ON s.path = l.path AND s.mtime_s = l.mtime_s AND s.file_size = l.file_size"


@register("store_lookup", S.with_ctes("store", "listing") + f"""
SELECT l.path, l.mtime_s, l.file_size, {_HIT} AS cached, s.quality_score AS cached_quality FROM {_JOIN}""")
def store_lookup(spark, d):
    store, listing = _store_listing(spark, d)
    return ST.lookup(listing, store).select("path", F.unix_seconds("mtime").alias("mtime_s"), "file_size",
                                             "cached", "cached_quality")


@register("incremental_split", S.with_ctes("store", "listing") + f"""
SELECT l.path, CASE WHEN {_HIT} THEN 'hit' ELSE 'miss' END AS status FROM {_JOIN}""")
def incremental_split(spark, d):
    store, listing = _store_listing(spark, d)
    hits, misses = ST.split_hits(listing, store)
    return hits.select("path", F.lit("hit").alias("status")).unionByName(
        misses.select("path", F.lit("miss").alias("status")))


@register("store_hit_rate", S.with_ctes("store", "listing") + f"""
SELECT CAST(count(*) FILTER (WHERE {_HIT}) AS BIGINT) AS cache_hits,
       CAST(count(*) FILTER (WHERE NOT {_HIT}) AS BIGINT) AS cache_misses,
       CAST(count(*) AS BIGINT) AS total_files,
       CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE {_HIT}) * 100.0 / count(*), 6) END AS hit_rate
FROM {_JOIN}""")
def store_hit_rate(spark, d):
    store, listing = _store_listing(spark, d)
    return ST.hit_rate(listing, store)


def _analyzed_misses(spark, d, store, listing):
    """Misses analysed now: the manifest row of each missed file, at its current mtime."""
    _, misses = ST.split_hits(listing, store)
    m = FX.manifest_docs(spark, d, with_fp=False).drop("mtime", "file_size", "path")
    return misses.join(m, "id")


@register("incremental_merge", S.with_ctes("store", "listing") + f"""
SELECT s.path, s.mtime_s, s.file_size, s.quality_score, 'cache' AS origin FROM {_JOIN} WHERE {_HIT}
UNION ALL
SELECT l.path, l.mtime_s, l.file_size, m.quality_score, 'analyzed' FROM {_JOIN} JOIN m ON m.id = l.id WHERE NOT {_HIT}""")
def incremental_merge(spark, d):
    store, listing = _store_listing(spark, d)
    hits, _ = ST.split_hits(listing, store)
    new = _analyzed_misses(spark, d, store, listing)
    cols = ["path", F.unix_seconds("mtime").alias("mtime_s"), "file_size", "quality_score"]
    return hits.select(*cols, F.lit("cache").alias("origin")).unionByName(
        new.select(*cols, F.lit("analyzed").alias("origin")))


@register("store_upsert", S.with_ctes("store", "listing") + f"""
SELECT s.path, s.mtime_s, s.file_size, s.analysis_version,
       CASE WHEN EXISTS (SELECT 1 FROM listing l WHERE l.path = s.path AND l.mtime_s = s.mtime_s
                         AND l.file_size = s.file_size) THEN {FX.STORE_NOW} ELSE s.last_accessed_s END AS last_accessed_s
FROM store s
UNION ALL
SELECT l.path, l.mtime_s, l.file_size, 1, {FX.STORE_NOW} FROM {_JOIN} WHERE NOT {_HIT}""")
def store_upsert(spark, d):
    store, listing = _store_listing(spark, d)
    now = F.timestamp_seconds(F.lit(FX.STORE_NOW))
    hits, _ = ST.split_hits(listing, store)
    touched = ST.touch(store, hits, now)
    new = (_analyzed_misses(spark, d, store, listing)
           .withColumn("analysis_version", F.lit(1)).withColumn("created_at", now)
           .withColumn("last_accessed", now))
    snap = ST.upsert(touched, new)
    return snap.select("path", F.unix_seconds("mtime").alias("mtime_s"), "file_size", "analysis_version",
                       F.unix_seconds("last_accessed").alias("last_accessed_s"))


def _bucket_store(spark, d):
    """The old store as a bucketed table of its own, in the session's shared folder."""
    old = FX.store_old(spark, d)
    store = BucketStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}", old.schema)
    store.append(old, 0)
    return store


@register("store_table_split", SQL["incremental_split"])
def store_table_split(spark, d):
    """Hits and misses against the bucketed store: only the listing is shuffled."""
    hits, misses = ST.split_hits(FX.listing_now(spark, d), _bucket_store(spark, d).read())
    return hits.select("path", F.lit("hit").alias("status")).unionByName(misses.select("path", F.lit("miss").alias("status")))


@register("store_table_changes", S.with_ctes("store", "listing", "m") + f"""
SELECT path, mtime_s, file_size, quality_score FROM store WHERE path IN (SELECT path FROM listing)
UNION ALL
SELECT l.path, l.mtime_s, l.file_size, m.quality_score FROM {_JOIN} JOIN m ON m.id = l.id WHERE NOT {_HIT}""")
def store_table_changes(spark, d):
    """The bucketed store after a scan: misses appended (twice, as a replayed batch), files that are gone removed."""
    store, listing = _bucket_store(spark, d), FX.listing_now(spark, d)
    new = _analyzed_misses(spark, d, store.read(), listing)
    now = F.timestamp_seconds(F.lit(FX.STORE_NOW))
    new = cut_lineage(new.withColumns({"analysis_version": F.lit(ST.ANALYSIS_VERSION), "created_at": now, "last_accessed": now}))
    gone = cut_lineage(store.read().join(listing.select("path"), "path", "left_anti"))
    store.append(new, 1)
    store.append(new, 1)
    store.remove(gone, 2)
    return store.read().select("path", F.unix_seconds("mtime").alias("mtime_s"), "file_size", "quality_score")


@register("store_invalidate", S.with_ctes("store_failing") + """
SELECT path, mtime_s FROM store_failing WHERE path NOT IN (SELECT path FROM store_failing WHERE error IS NOT NULL)""")
def store_invalidate(spark, d):
    store = FX.store_old(spark, d, failing=True)
    return ST.invalidate(store, store.where(F.col("error").isNotNull())).select(
        "path", F.unix_seconds("mtime").alias("mtime_s"))


@register("store_invalidate_prefix", S.with_ctes("store") + """
SELECT path, mtime_s FROM store WHERE NOT starts_with(path, '/src1/')""")
def store_invalidate_prefix(spark, d):
    store, _ = _store_listing(spark, d)
    return ST.invalidate_prefix(store, "/src1").select("path", F.unix_seconds("mtime").alias("mtime_s"))


@register("store_evict_stale", S.with_ctes("store") + f"""
SELECT path, last_accessed_s FROM store WHERE last_accessed_s >= {FX.STORE_NOW} - 30 * {FX.DAY}""")
def store_evict_stale(spark, d):
    store, _ = _store_listing(spark, d)
    now = F.timestamp_seconds(F.lit(FX.STORE_NOW))
    return ST.evict_stale(store, now, 30).select("path", F.unix_seconds("last_accessed").alias("last_accessed_s"))


@register("store_evict_missing", S.with_ctes("store", "listing") + """
SELECT path FROM store WHERE path IN (SELECT path FROM listing)""")
def store_evict_missing(spark, d):
    store, listing = _store_listing(spark, d)
    return ST.evict_missing(store, listing).select("path")


@register("store_stats", S.with_ctes("store") + """
SELECT CAST(count(*) AS BIGINT) AS total_entries, CAST(count(DISTINCT path) AS BIGINT) AS distinct_paths FROM store""")
def store_stats(spark, d):
    store, _ = _store_listing(spark, d)
    return ST.stats(store)


@register("perceptual_only", S.with_ctes("groups_po") + f"""
SELECT {_G.replace('is_best', 'member_rank = 1 AS is_best')} FROM groups_po""")
def perceptual_only(spark, d):
    return _groups_all(spark, d, mode="perceptual_only").select(*GROUP_COLUMNS)


@register("find_duplicates_lsh", S.with_ctes("groups_lsh") + f"""
SELECT {_G.replace('is_best', 'member_rank = 1 AS is_best')} FROM groups_lsh""")
def find_duplicates_lsh(spark, d):
    g = find_duplicates(FX.manifest_docs(spark, d), threshold=S.T_TEXT, use_lsh=True,
                        lsh_tables_bits=(S.LSH_TABLES, S.LSH_BITS))
    return g.select(*GROUP_COLUMNS)
