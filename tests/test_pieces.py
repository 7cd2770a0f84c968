import hashlib
import os

from pyspark.sql import functions as F

from conftest import pattern, png_bytes
from neardup.session import cut_lineage
from neardup.sources import files as FS, pieces
from neardup.sources.discovery import discover
from test_headers import png, tiff


def names(df):
    return sorted(os.path.basename(r.path) for r in df.collect())


def test_hidden_names_and_links(spark, scratch):
    root = scratch + "/tree"
    os.makedirs(root + "/.hidden/_deep")
    os.makedirs(scratch + "/outside")
    for name in ("a.png", "_b.png", ".c.png", ".hidden/d.PNG", ".hidden/_deep/e f+g.png", "x.txt", "../outside/real.bin", "../outside/o.png"):
        with open(os.path.join(root, name), "wb") as f:
            f.write(name.encode())
    os.symlink(root + "/a.png", root + "/link.png")                       # the same file once
    os.symlink(scratch + "/outside/real.bin", root + "/other.png")        # a file elsewhere, whatever its name
    os.symlink(scratch + "/outside", root + "/folder")                    # links to folders are not followed
    os.symlink(root + "/nothing.png", root + "/dangling.png")
    assert names(FS.find_image_files(spark, root)) == [".c.png", "_b.png", "a.png", "d.PNG", "e f+g.png", "real.bin"]
    assert names(FS.find_image_files(spark, root, recursive=False)) == [".c.png", "_b.png", "a.png", "real.bin"]
    assert names(discover(spark, root, [".txt"])) == ["x.txt"]
    row = next(r for r in discover(spark, root).collect() if r.path.endswith("/a.png"))
    assert row.file_size == 5 and row.mtime.timestamp() == int(os.stat(root + "/a.png").st_mtime * 1000) / 1000
    assert discover(spark, scratch + "/no such folder").collect() == []
    hashes = {os.path.basename(r.path): r.file_hash for r in FS.content_hashes(spark, root).collect()}
    assert hashes["e f+g.png"] == hashlib.sha256(b".hidden/_deep/e f+g.png").hexdigest()


def test_many_folders_are_listed_by_tasks(spark, scratch):
    for i in range(90):
        os.makedirs(f"{scratch}/many/{i}/in")
        open(f"{scratch}/many/{i}/in/{i}.png", "wb").close()
    assert discover(spark, scratch + "/many", [".png"]).count() == 90


def test_large_and_unreadable_files_are_records(spark, scratch):
    os.makedirs(scratch + "/big")
    body = os.urandom(300_000)
    with open(scratch + "/big/large.tga", "wb") as f:
        f.write(body)
    with open(scratch + "/big/gone.png", "wb") as f:
        f.write(png_bytes(pattern(8, 8)))
    old = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        listing = cut_lineage(FS.find_image_files(spark, scratch + "/big"))
        os.remove(scratch + "/big/gone.png")
        rows = {os.path.basename(r.path): r for r in FS.analyze_listed(spark, listing, with_phash=False).collect()}
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", old)
    assert rows["large.tga"].file_hash == hashlib.sha256(body).hexdigest() and rows["large.tga"].error is None
    assert rows["gone.png"].error.startswith("cannot read file") and rows["gone.png"].file_hash is None
    assert rows["gone.png"].quality_score == 0.0


def test_real_bit_depths_reach_the_manifest(spark, scratch):
    os.makedirs(scratch + "/modes")
    for name, data in (("one.png", png(8, 8, 1, 0)), ("deep.png", png(8, 8, 16, 0)),
                       ("float.tif", tiff(b"II", [(256, 3, [9]), (257, 3, [8]), (258, 3, [32]), (262, 3, [1]), (339, 3, [3])]))):
        with open(f"{scratch}/modes/{name}", "wb") as f:
            f.write(data)
    rows = {os.path.basename(r.path): r for r in FS.analyze(spark, scratch + "/modes", with_phash=False).collect()}
    assert {n: r.bit_depth for n, r in rows.items()} == {"one.png": 1, "deep.png": 16, "float.tif": 32}
    assert rows["float.tif"].pixel_count == 72 and rows["float.tif"].format == "TIFF"


def test_a_second_run_opens_changed_files_only(spark, image_dir):
    store = cut_lineage(FS.analyze(spark, image_dir).withColumn("analysis_version", F.lit(1)))
    new = os.path.join(image_dir, "sub", "copied [1].png")
    with open(new, "wb") as f:
        f.write(png_bytes(pattern(40, 30, "rings")))
    os.utime(new, (1_000_000_000, 1_000_000_000))          # older than every known file
    for known in ("identical1.png", "unique.png"):         # same size and time, not opened: no one sees the change
        path = os.path.join(image_dir, known)
        info = os.stat(path)
        with open(path, "r+b") as f:
            f.write(b"\x00" * 64)
        os.utime(path, ns=(info.st_atime_ns, info.st_mtime_ns))
    hits, found = FS.analyze_new(spark, image_dir, store)
    rows = found.collect()
    assert [os.path.basename(r.path) for r in rows] == ["copied [1].png"] and rows[0].width == 40 and rows[0].fp
    assert hits.count() == store.count()
    only = FS.pixel_hashes(spark, found.select("path"))
    assert {os.path.basename(p) for p in only.inputFiles()} == {"copied%20%5B1%5D.png"}


def test_shares_are_balanced_by_bytes(spark):
    sizes = [pieces.SHARE * 3] + [pieces.SHARE // 10] * 40 + [0] * 500
    listing = spark.createDataFrame([(f"p{i:04}", None, s) for i, s in enumerate(sizes)], "path string, mtime timestamp, file_size long")
    shared = pieces.by_shares(listing).withColumn("task", F.spark_partition_id())
    tasks = shared.groupBy("task").agg(F.sum("file_size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(t.n for t in tasks) == len(sizes) and len(tasks) >= 5
    assert sorted(t.bytes for t in tasks)[-2] <= 2 * pieces.SHARE
