from pyspark.sql import functions as F

from neardup.operators import report as REP
from neardup.operators.ranking import running_total

SCHEMA = "group_id long, match_type string, path string, member_rank int, is_best boolean, width int, height int, file_size long, quality_score double"


def groups(spark):
    rows = []
    for g, (match, n) in enumerate([("exact", 3), ("exact", 2), ("perceptual", 2)], 1):
        rows += [(g, match, f"/p{g}/{k}.png", k, k == 1, 10 * k, 20, 1024 * k, 50.0 - k) for k in range(1, n + 1)]
    return spark.createDataFrame(rows, SCHEMA)


def text(spark, df):
    rows = sorted((r.line_no, r.line) for r in REP.report_document(df).collect())
    assert [n for n, _ in rows] == list(range(1, len(rows) + 1))
    return [line for _, line in rows]


def test_document_in_order(spark, scratch):
    lines = text(spark, groups(spark))
    rule, thin = "=" * 70, "-" * 70
    assert lines[:12] == ["", rule, "DUPLICATE IMAGE REPORT", rule, "", "Exact duplicates found: 3 files in 2 groups",
                          "Perceptual duplicates found: 1 files in 1 groups", "", thin, "EXACT DUPLICATES (identical files)", thin, ""]
    assert lines[12:16] == ["Group 1 (3 files):", "  [KEEP] /p1/1.png", "         10x20 | 1.0 KB | Score: 49.0", "  [DUPE] /p1/2.png"]
    at = lines.index("PERCEPTUAL DUPLICATES (visually similar)")
    assert lines[at - 2:at + 4] == ["", thin, "PERCEPTUAL DUPLICATES (visually similar)", thin, "", "Group 1 (2 files):"]
    assert lines[-4:] == ["", rule, "Total space recoverable: 9.0 KB", rule]
    REP.write_document(groups(spark), scratch + "/doc")
    written = [r.value for r in spark.read.text(scratch + "/doc").withColumn("f", F.input_file_name()).collect()]
    assert sorted(written) == sorted(lines)


def test_one_section_and_none(spark):
    lines = text(spark, groups(spark).where("match_type = 'perceptual'"))
    assert not any("EXACT DUPLICATES" in x for x in lines) and "Group 1 (2 files):" in lines
    lines = text(spark, groups(spark).limit(0))
    assert len(lines) == 11 and lines[-2] == "Total space recoverable: 0.0 B"


def test_running_total(spark):
    df = spark.range(0, 500, 1, 7).select(F.col("id"), (F.col("id") % 5).alias("v"))
    rows = running_total(df, ["id"], "v", "before").collect()
    assert all(r.before == sum(i % 5 for i in range(r.id)) for r in rows) and len(rows) == 500
