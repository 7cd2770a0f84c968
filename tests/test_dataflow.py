import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from neardup.operators import actions as ACT, report as REP, selection as SEL
from neardup.plans.dataflow import find_duplicates
from neardup.session import cut_lineage

SCHEMA = ("id long, path string, mtime timestamp, file_size long, width int, height int, "
          "pixel_count long, bit_depth int, format string, file_hash string, perceptual_hash string, "
          "fp array<long>, quality_score double, error string")


def fp(v):
    out = []
    for k in range(4):
        w = (v >> (256 - 64 * (k + 1))) & ((1 << 64) - 1)
        out.append(w - (1 << 64) if w >= 1 << 63 else w)
    return out


def row(i, path, size, q, h, f, err=None):
    return (i, path, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), size, 10, 10, 100, 24, "PNG", h, None,
            f, q, err)


@pytest.fixture()
def manifest(spark):
    rng = random.Random(5)
    a = rng.getrandbits(256)
    b = a ^ 0b111                      # 3 bits from a
    c = b ^ (0b11 << 100)              # 2 bits from b, 5 from a
    far = rng.getrandbits(256)
    rows = [
        row(1, "/p/a1.png", 1000, 50.0, "h1", fp(a)),
        row(2, "/p/a2.png", 2000, 75.0, "h1", fp(a)),     # exact copy of 1
        row(3, "/p/a3.png", 1500, 60.0, "h1", fp(a)),
        row(4, "/p/b.png", 700, 40.0, "h2", fp(b)),        # near 1..3 but those are exact members
        row(5, "/p/c.png", 800, 45.0, "h3", fp(c)),        # near b
        row(6, "/p/far.png", 900, 30.0, "h4", fp(far)),
        row(7, "/p/broken.png", 900, 0.0, "h1", None, "cannot identify image file"),
        row(8, "/p/nohash.png", 100, 1.0, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_exact_group_best_and_savings(spark, manifest):
    g = find_duplicates(manifest, threshold=4, mode="exact_only")
    rows = g.orderBy("member_rank").collect()
    assert [r.path for r in rows] == ["/p/a2.png", "/p/a3.png", "/p/a1.png"]
    assert [r.is_best for r in rows] == [True, False, False]
    assert {r.group_id for r in rows} == {1}
    best = SEL.best_per_group(g).first()
    assert (best.best_path, best.best_quality) == ("/p/a2.png", 75.0)
    stats = {r.match_type: r for r in REP.group_stats(g).collect()}
    assert stats["exact"].total_waste == 2500 and stats["exact"].total_duplicates == 2


def test_exact_members_leave_the_similarity_stage(spark, manifest):
    g = find_duplicates(manifest, threshold=4)
    by_type = {}
    for r in g.collect():
        by_type.setdefault(r.match_type, set()).add(r.path)
    assert by_type["exact"] == {"/p/a1.png", "/p/a2.png", "/p/a3.png"}
    assert by_type["perceptual"] == {"/p/b.png", "/p/c.png"}
    ids = sorted({(r.match_type, r.group_id) for r in g.collect()})
    assert ids == [("exact", 1), ("perceptual", 2)]


def test_perceptual_only_and_transitivity(spark, manifest):
    g = find_duplicates(manifest, threshold=3, mode="perceptual_only")
    groups = {}
    for r in g.collect():
        groups.setdefault(r.group_id, set()).add(r.path)
    # a~b (3 bits), b~c (2 bits): one group although a-c is 5 bits apart
    assert list(groups.values()) == [{"/p/a1.png", "/p/a2.png", "/p/a3.png", "/p/b.png", "/p/c.png"}]


def test_one_keep_per_group_every_strategy(spark, manifest):
    g = find_duplicates(manifest, threshold=4)
    for s in ("quality", "largest", "smallest", "newest", "oldest", "unknown"):
        sel = SEL.selections(g, s)
        keeps = sel.where("decision = 'keep'").groupBy("group_id").count().collect()
        assert all(r["count"] == 1 for r in keeps) and len(keeps) == 2
    largest = {r.path for r in SEL.selections(g, "largest").where("decision='keep'").collect()}
    assert largest == {"/p/a2.png", "/p/c.png"}
    oldest = {r.path for r in SEL.selections(g, "oldest").where("decision='keep'").collect()}
    assert oldest == {"/p/a1.png", "/p/b.png"}


def test_threshold_zero_and_validation(spark, manifest):
    g = find_duplicates(manifest, threshold=0, mode="perceptual_only")
    assert {r.path for r in g.collect()} == {"/p/a1.png", "/p/a2.png", "/p/a3.png"}
    with pytest.raises(ValueError):
        find_duplicates(manifest, threshold=-1)
    with pytest.raises(ValueError):
        find_duplicates(manifest, mode="exact_and_perceptual")


def test_lsh_strategy_forced(spark, manifest):
    g = find_duplicates(manifest, threshold=4, use_lsh=True)
    assert g.where("match_type = 'perceptual'").count() in (0, 2)


def test_action_plan_and_unique_names(spark):
    rows = [(1, "/a/x.jpg", 1, True, 10), (1, "/b/x.jpg", 2, False, 20), (2, "/c/y.jpg", 1, True, 5),
            (2, "/d/x.jpg", 2, False, 7), (3, "/e/z", 1, True, 1), (3, "/f/x.jpg", 2, False, 3)]
    g = spark.createDataFrame(rows, "group_id long, path string, member_rank int, is_best boolean, file_size long")
    plan = {r.path: r.target for r in ACT.action_plan(g, "move", "/trash/").collect()}
    assert plan == {"/b/x.jpg": "/trash/x.jpg", "/d/x.jpg": "/trash/x_1.jpg", "/f/x.jpg": "/trash/x_2.jpg"}
    taken = [(1, "/a/k", 1, True, 1), (1, "/a/x.jpg", 2, False, 1), (2, "/b/k", 1, True, 1), (2, "/b/x.jpg", 2, False, 1),
             (3, "/c/k", 1, True, 1), (3, "/c/x_1.jpg", 2, False, 1), (3, "/c/x_1.jpg/y", 3, False, 1)]
    t = spark.createDataFrame(taken, g.schema)
    names = [r.target for r in ACT.action_plan(t, "move", "/trash").collect()]
    assert sorted(names) == ["/trash/x.jpg", "/trash/x_1.jpg", "/trash/x_2.jpg", "/trash/y"]
    there = spark.createDataFrame([("x.jpg",), ("x_2.jpg",), ("x_2.jpg",), ("other",)], "name string")
    names = [r.target for r in ACT.action_plan(t, "move", "/trash", there).collect()]
    assert sorted(names) == ["/trash/x_1.jpg", "/trash/x_3.jpg", "/trash/x_4.jpg", "/trash/y"]
    hl = {r.path: (r.target, r.keeper) for r in ACT.action_plan(g, "hardlink").collect()}
    assert hl["/d/x.jpg"] == ("/c/y.jpg", "/c/y.jpg")
    s = ACT.action_summary(ACT.action_plan(g, "delete")).first()
    assert (s.processed, s.space_saved) == (3, 30)
    listing = spark.createDataFrame([("/a/x.jpg",), ("/b/x.jpg",), ("/d/x.jpg",)], "path string")
    s = ACT.action_summary(ACT.action_plan(g, "symlink"), listing).first()
    assert (s.processed, s.skipped, s.errors, s.space_saved) == (1, 1, 1, 20)
    with pytest.raises(ValueError):
        ACT.action_plan(g, "move")


def test_keeper_is_the_best_by_quality_whatever_is_selected(spark, manifest):
    by_quality = {r.path: r.is_best for r in find_duplicates(manifest, threshold=4).collect()}
    g = find_duplicates(manifest, threshold=4, strategy="oldest")
    assert {r.path: r.is_best for r in g.collect()} == by_quality
    assert {r.path for r in g.where("selected").collect()} == {"/p/a1.png", "/p/b.png"}
    status = {r.path: r.status for r in REP.export_rows(g).collect()}
    assert all((s == "keep") == by_quality[p] for p, s in status.items())


def test_empty_hashes_form_no_group(spark, manifest):
    unread = manifest.withColumn("file_hash", F.lit(""))
    assert find_duplicates(unread, mode="exact_only").count() == 0


@pytest.mark.parametrize("join", ["members", "exclude", "hub", "collapse", "rank"])
def test_hot_keys_are_split(spark, join):
    """Half of all rows share a key; with broadcasts off the final plan has a split join."""
    from neardup.operators import components, exact, hamming, ranking
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "20k",
            "spark.sql.files.openCostInBytes": "1k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 20_000
        half = F.col("id") < n // 2
        hot = cut_lineage(spark.range(n).withColumn("file_hash", F.when(half, F.lit("hot")).otherwise(
            F.concat(F.lit("h"), (F.col("id") % 4000).cast("string")))).withColumn("path", F.col("id").cast("string")))
        if join in ("members", "exclude"):
            f = exact.exact_members if join == "members" else exact.exclude_exact
            df = f(hot, exact.exact_hash_groups(hot))
        elif join == "hub":
            e = cut_lineage(spark.range(1, n).select(F.when(F.col("id") < n // 2, F.lit(0)).otherwise(F.col("id") - 1).cast("long").alias("lo"),
                                                     F.col("id").alias("hi")))
            df = components._large_star(e)
        elif join == "collapse":
            fp = hot.withColumn("fp", F.array(F.when(half, F.lit(0)).otherwise(F.col("id") % 4000).cast("long")))
            _, df = hamming.collapse(fp)
        else:
            df = ranking.rank_in_group(hot, ["file_hash"], ["path"], max_window_rows=10)
        df.write.format("noop").mode("overwrite").save()
        df.count()
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert rows is not None and "skew=true" in plan, plan
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_report_and_export(spark, manifest, scratch):
    g = find_duplicates(manifest, threshold=4)
    lines = [r.line for r in REP.report_lines(g).orderBy("group_id", "seq").collect()]
    assert lines[0] == "Group 1 (3 files):" and lines[1] == "  [KEEP] /p/a2.png"
    assert lines[2].startswith("         10x10 | 2.0 KB | Score: 75.0")
    REP.write_csv(g, scratch + "/csv")
    text = spark.read.csv(scratch + "/csv", header=True)
    assert text.count() == 5 and set(text.columns) >= {"group_id", "status", "quality_score"}
    REP.export_results(g, scratch + "/txt", "txt")
    assert spark.read.text(scratch + "/txt").count() == 2 + 2 * 5
    with pytest.raises(ValueError):
        REP.export_results(g, scratch + "/x", "xlsx")
    REP.write_json(g, scratch + "/json")
    back = REP.read_json(spark, scratch + "/json")
    assert back.count() == 2 and back.where("group_id = 1").first().image_count == 3
    nested = REP.groups_nested(g).where("group_id = 1").first()
    assert nested.best_path == "/p/a2.png" and nested.potential_savings == 2500
    assert [m.path for m in nested.images] == ["/p/a2.png", "/p/a3.png", "/p/a1.png"]


def test_hot_bucket_path_gives_same_groups(spark):
    import random as _r
    rng = _r.Random(11)
    base = rng.getrandbits(256)
    rows = []
    for i in range(120):                          # one dense cluster sharing most band values
        v = base
        for _ in range(rng.randint(0, 6)):
            v ^= 1 << rng.randrange(256)
        rows.append(row(i, f"/c/{i:03d}.png", 100 + i, float(i % 7), f"h{i}", fp(v)))
    for i in range(120, 160):                     # unrelated rows
        rows.append(row(i, f"/u/{i:03d}.png", 100, 1.0, f"h{i}", fp(rng.getrandbits(256))))
    m = spark.createDataFrame(rows, SCHEMA)

    def groups(df):
        out = {}
        for r in df.collect():
            out.setdefault(r.group_id, set()).add(r.path)
        return sorted(map(sorted, out.values()))

    for lsh in (False, True):
        normal = groups(find_duplicates(m, threshold=8, use_lsh=lsh))
        hot = groups(find_duplicates(m, threshold=8, use_lsh=lsh, hot_bucket_rows=2))
        assert normal == hot and len(normal[0]) > 100


def test_fewer_than_two_candidates(spark, manifest):
    empty = manifest.limit(0)
    assert find_duplicates(empty, threshold=4).count() == 0
    one = manifest.where("id = 6")
    assert find_duplicates(one, threshold=64, mode="perceptual_only").count() == 0


def test_nested_documents_are_paged(spark):
    rows = [(1, f"/g/{i:03d}.png", i, i == 1, 10) for i in range(1, 26)]
    g = spark.createDataFrame(rows, "group_id long, path string, member_rank int, is_best boolean, file_size long") \
        .withColumn("match_type", F.lit("exact")).withColumn("width", F.lit(1)).withColumn("height", F.lit(1)) \
        .withColumn("quality_score", F.lit(1.0))
    docs = REP.groups_nested(g, page_size=10).orderBy("page").collect()
    assert [d.page for d in docs] == [0, 1, 2]
    assert [len(d.images) for d in docs] == [10, 10, 5]
    assert [m.path for d in docs for m in d.images] == [r[1] for r in rows]
    assert all(d.image_count == 25 and d.best_path == "/g/001.png" and d.potential_savings == 240 for d in docs)
