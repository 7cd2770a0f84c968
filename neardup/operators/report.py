"""Reports, export rows and nested group documents built from the groups table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from neardup.functions.scalars import (directory, filename, format_size, megapixels, one_decimal,
                                       resolution)
from neardup.operators.ranking import global_index, running_total
from neardup.session import cut_lineage


def manifest_projection(manifest: DataFrame) -> DataFrame:
    """The per-file report record: derived names, resolution, megapixels, sizes."""
    return manifest.select(
        "path", filename("path").alias("filename"), directory("path").alias("directory"),
        "file_size", format_size("file_size").alias("file_size_formatted"),
        "width", "height", resolution("width", "height").alias("resolution"),
        "pixel_count", megapixels("pixel_count").alias("megapixels"), "format",
        one_decimal("quality_score").alias("quality_1dp"), "error")


def group_stats(groups: DataFrame) -> DataFrame:
    """Per match type and in total: duplicate files, groups, bytes beyond each keeper.

    One ``rollup`` pass gives the per-type rows and the grand total. Waste
    excludes the best member by quality whatever the selection, as in the
    original report.
    """
    dupe = ~F.col("is_best")
    out = groups.rollup("match_type").agg(
        F.count_if(dupe).cast("bigint").alias("total_duplicates"),
        F.count_if(F.col("is_best")).cast("bigint").alias("total_groups"),   # one best in each group
        F.coalesce(F.sum(F.when(dupe, F.col("file_size")).otherwise(0)), F.lit(0)).cast("bigint").alias("total_waste"),
        F.grouping("match_type").alias("_total"))
    out = out.select(F.when(F.col("_total") == 1, F.lit("total")).otherwise(F.col("match_type")).alias("match_type"),
                     "total_duplicates", "total_groups", "total_waste")
    return out.withColumn("total_waste_formatted", format_size("total_waste"))


def scan_summary(manifest: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: files, errors, exact/similar groups and their member counts.

    Both inputs are tagged and unioned, so one aggregate produces the row (no join).
    """
    m = manifest.select(F.lit(True).alias("_m"), F.col("error"),
                        F.lit(None).cast("bigint").alias("group_id"), F.lit(None).cast("string").alias("match_type"))
    g = groups.select(F.lit(False).alias("_m"), F.lit(None).cast("string").alias("error"), "group_id", "match_type")
    u = m.unionByName(g)
    ex, pe = F.col("match_type") == "exact", F.col("match_type") == "perceptual"
    out = u.agg(
        F.count_if(F.col("_m")).cast("bigint").alias("total_files"),
        F.count_if(F.col("_m") & F.col("error").isNotNull()).cast("bigint").alias("errors"),
        F.countDistinct(F.when(ex, F.col("group_id"))).cast("bigint").alias("exact_groups"),
        F.countDistinct(F.when(pe, F.col("group_id"))).cast("bigint").alias("similar_groups"),
        F.count_if(ex).cast("bigint").alias("exact_files"),
        F.count_if(pe).cast("bigint").alias("similar_files"))
    return out.withColumn("total_groups", F.col("exact_groups") + F.col("similar_groups"))


def report_lines(groups: DataFrame) -> DataFrame:
    """Text report lines (group_id, seq, line): a header per group, two lines per member."""
    head = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).select(
        "group_id", F.lit(0).alias("seq"), F.format_string("Group %d (%d files):", "group_id", "n").alias("line"))
    mark = F.when(F.col("is_best"), F.lit("  [KEEP] ")).otherwise(F.lit("  [DUPE] "))
    first = F.struct((F.col("member_rank") * 2 - 1).alias("seq"), F.concat(mark, "path").alias("line"))
    detail = F.struct((F.col("member_rank") * 2).alias("seq"), F.concat(
        F.lit("         "), resolution("width", "height"), F.lit(" | "), format_size("file_size"),
        F.lit(" | Score: "), one_decimal("quality_score")).alias("line"))
    members = groups.select("group_id", F.explode(F.array(first, detail)).alias("l")).select(
        "group_id", F.col("l.seq").alias("seq"), F.col("l.line").alias("line"))
    return head.unionByName(members)


RULE = 70
SECTIONS = (("exact", "EXACT DUPLICATES (identical files)"), ("perceptual", "PERCEPTUAL DUPLICATES (visually similar)"))


def report_document(groups: DataFrame) -> DataFrame:
    """The whole text report (line_no from 1, line): title, counts, a section for each kind of match, total.

    Group numbers start anew in each section. A group's first line follows from the lines of the
    groups before it, a running total over range partitions, and a member's line from its
    rank; so no task sees all lines, and ``line_no`` alone orders them.
    """
    groups = cut_lineage(groups)
    dupe = F.when(~F.col("is_best"), F.col("file_size")).otherwise(F.lit(0))
    sums = {r.match_type: r for r in groups.groupBy("match_type").agg(
        F.countDistinct("group_id").alias("groups"), F.count(F.lit(1)).alias("files"), F.sum(dupe).alias("waste")).collect()}
    counts = [(sums[m].groups, sums[m].files - sums[m].groups) if m in sums else (0, 0) for m, _ in SECTIONS]
    rule, thin = "=" * RULE, "-" * RULE
    lines = ["", rule, "DUPLICATE IMAGE REPORT", rule, ""]
    lines += [f"{kind} duplicates found: {files} files in {n} groups" for kind, (n, files) in zip(("Exact", "Perceptual"), counts)]
    fixed, starts, at = list(enumerate(lines, 1)), {}, len(lines)
    for (match, title), (n, files) in zip(SECTIONS, counts):
        starts[match] = at
        if n:
            fixed += [(at + k, text) for k, text in enumerate(["", thin, title, thin], 1)]
            starts[match] = at + 4
            at += 4 + 2 * n + 2 * (files + n)
    end = [*enumerate(["", rule], at + 1), *enumerate([rule], at + 4)]
    spark = groups.sparkSession
    frame = spark.createDataFrame([(i, t) for i, t in fixed + end], "line_no bigint, line string")
    waste = sum(r.waste or 0 for r in sums.values())
    total = spark.createDataFrame([(at + 3, waste)], "line_no bigint, waste bigint").select(
        "line_no", F.concat(F.lit("Total space recoverable: "), format_size("waste")).alias("line"))

    heads = groups.groupBy("match_type", "group_id").agg((F.count(F.lit(1)) * 2 + 2).alias("lines"))
    placed = None
    for match, _ in SECTIONS:
        part = running_total(heads.where(F.col("match_type") == match), ["group_id"], "lines", "before")
        part = global_index(part.withColumn("start", (F.col("before") + starts[match]).cast("bigint")), ["group_id"], "number")
        placed = part if placed is None else placed.unionByName(part)
    placed = cut_lineage(placed)
    head = placed.select(F.explode(F.array(
        F.struct((F.col("start") + 1).alias("line_no"), F.lit("").alias("line")),
        F.struct((F.col("start") + 2).alias("line_no"),
                 F.format_string("Group %d (%d files):", "number", F.expr("(lines - 2) div 2")).alias("line")))).alias("l")).select("l.*")
    mark = F.when(F.col("is_best"), F.lit("  [KEEP] ")).otherwise(F.lit("  [DUPE] "))
    detail = F.concat(F.lit("         "), resolution("width", "height"), F.lit(" | "), format_size("file_size"),
                      F.lit(" | Score: "), one_decimal("quality_score"))
    first = F.col("start") + 1 + 2 * F.col("member_rank")
    members = groups.join(placed.select("group_id", "start"), "group_id").select(F.explode(F.array(
        F.struct(first.alias("line_no"), F.concat(mark, "path").alias("line")),
        F.struct((first + 1).alias("line_no"), detail.alias("line")))).alias("l")).select("l.*")
    return frame.unionByName(total).unionByName(head).unionByName(members)


def write_document(groups: DataFrame, path: str) -> None:
    """The text report as files whose names and lines are in order."""
    report_document(groups).orderBy("line_no").select("line").write.mode("overwrite").text(path)


def export_rows(groups: DataFrame) -> DataFrame:
    """CSV records: group_id, match_type, status (keep/duplicate by quality), path, width,
    height, file_size, quality (one decimal)."""
    return groups.select(
        "group_id", "match_type",
        F.when(F.col("is_best"), F.lit("keep")).otherwise(F.lit("duplicate")).alias("status"),
        "path", "width", "height", "file_size", one_decimal("quality_score").alias("quality_score"))


def write_csv(groups: DataFrame, path: str) -> None:
    """Ordered CSV export with a header; quotes inside paths are escaped by doubling."""
    (export_rows(groups).orderBy("group_id", "status", "path")
     .write.mode("overwrite").csv(path, header=True, quote='"', escape='"'))


def write_report(groups: DataFrame, path: str) -> None:
    (report_lines(groups).orderBy("group_id", "seq").select("line")
     .write.mode("overwrite").text(path))


GROUP_PAGE_SIZE = 10_000   # members per nested document; bounds the row a task builds


def groups_nested(groups: DataFrame, choices: DataFrame | None = None,
                  page_size: int = GROUP_PAGE_SIZE) -> DataFrame:
    """Nested group documents: members sorted by rank, best_path, selected_keep, savings.

    A group of up to ``page_size`` members is one document (``page`` 0); a larger
    group continues on further pages, so no task ever collects an unbounded group.
    Group-level fields come from partial aggregates and repeat on every page.
    """
    member = F.struct(F.col("member_rank").alias("rank"), "path", filename("path").alias("filename"),
                      "file_size", format_size("file_size").alias("file_size_formatted"),
                      "width", "height", F.round("quality_score", 1).alias("quality_score"))
    paged = groups.withColumn("page", F.floor((F.col("member_rank") - 1) / F.lit(page_size)).cast("int"))
    pages = paged.groupBy("group_id", "page").agg(F.sort_array(F.collect_list(member)).alias("images"))
    summary = groups.groupBy("group_id", "match_type").agg(
        F.count(F.lit(1)).alias("image_count"),
        F.max_by("path", F.col("is_best").cast("int")).alias("best_path"),
        F.sum(F.when(~F.col("is_best"), F.col("file_size")).otherwise(0)).cast("bigint").alias("potential_savings"))
    if choices is not None:
        summary = summary.join(choices.select("group_id", "selected_keep"), "group_id", "left")
    else:
        summary = summary.withColumn("selected_keep", F.lit(None).cast("string"))
    g = summary.join(pages, "group_id")
    return g.select("group_id", "page", "match_type", "image_count", "images", "best_path",
                    F.coalesce("selected_keep", "best_path").alias("selected_keep"),
                    "potential_savings", format_size("potential_savings").alias("potential_savings_formatted"))


def write_json(groups: DataFrame, path: str, choices: DataFrame | None = None) -> None:
    """Nested group documents, one JSON object per line."""
    groups_nested(groups, choices).write.mode("overwrite").json(path)


def read_json(spark, path: str) -> DataFrame:
    """Read nested group documents back; missing keys come back as NULL."""
    schema = ("group_id BIGINT, page INT, match_type STRING, image_count BIGINT, "
              "images ARRAY<STRUCT<rank: INT, path: STRING, filename: STRING, file_size: BIGINT, "
              "file_size_formatted: STRING, width: INT, height: INT, quality_score: DOUBLE>>, "
              "best_path STRING, selected_keep STRING, potential_savings BIGINT, potential_savings_formatted STRING")
    return spark.read.schema(schema).json(path)


EXPORT_FORMATS = ("txt", "csv")


def export_results(groups: DataFrame, path: str, export_format: str = "txt") -> None:
    """Write the text report (``txt``) or CSV rows (``csv``); any other format is refused."""
    if export_format not in EXPORT_FORMATS:
        raise ValueError(f"export_format must be one of {EXPORT_FORMATS}, not {export_format!r}")
    (write_report if export_format == "txt" else write_csv)(groups, path)
