import os
import shutil

from neardup.sources import files as FS
from neardup.streaming import arrivals as AR

FIELDS = ["width", "height", "pixel_count", "bit_depth", "format", "file_hash", "fp", "perceptual_hash", "quality_score", "error"]


def run(spark, scratch, src, **options):
    q = AR.start(spark, src, scratch + "/store", scratch + "/dups", scratch + "/ckpt", **options)
    q.awaitTermination(180)
    assert q.exception() is None
    return q


def dups(spark, scratch, batch=None):
    rows = spark.read.parquet(scratch + "/dups").collect()
    return {(os.path.basename(r.path), os.path.basename(r.first_path), r.reason) for r in rows if batch is None or r.batch == batch}


def test_two_batches_and_replay(spark, image_dir, scratch):
    src = scratch + "/incoming"
    os.makedirs(src)
    for name in ("identical1.png", "unique.png", "notes.txt", "corrupted.png"):
        shutil.copy(os.path.join(image_dir, name), src)
    run(spark, scratch, src)
    assert dups(spark, scratch) == set()
    shutil.copy(os.path.join(image_dir, "identical2.png"), src)
    for name in ("s1.png", "s2.png"):
        shutil.copy(os.path.join(image_dir, "similar.PNG"), os.path.join(src, name))
    q = run(spark, scratch, src)
    want = {("identical2.png", "identical1.png", "store"), ("s2.png", "s1.png", "batch")}
    assert dups(spark, scratch) == want
    # the batch's plan reads neither the store nor the duplicates
    plan = q._jsq.explainInternal(True)
    assert scratch + "/store" not in plan and "FlatMapGroupsInPandasWithState" in plan

    # a crash after the batch's writes and before its commit: played again, with the same result
    commits = scratch + "/ckpt/commits"
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(os.path.join(commits, name)):
            os.remove(os.path.join(commits, name))
    run(spark, scratch, src)
    assert dups(spark, scratch) == want
    store = spark.read.parquet(scratch + "/store")
    assert store.count() == 6 and store.select("path").distinct().count() == 6

    # a streamed row equals the row of a batch analysis, pixels and quality too
    streamed = {r.path: [r[c] for c in FIELDS] for r in store.collect()}
    analysed = {r.path: [r[c] for c in FIELDS] for r in FS.analyze(spark, src).collect()}
    assert streamed == analysed


def test_store_from_before_is_read_once(spark, image_dir, scratch):
    src = scratch + "/incoming"
    os.makedirs(src)
    known = FS.analyze(spark, image_dir).select("path", "mtime", "file_size", "file_hash")
    known.write.parquet(scratch + "/known")
    shutil.copy(os.path.join(image_dir, "unique.png"), os.path.join(src, "again.png"))
    run(spark, scratch, src, known_dir=scratch + "/known")
    assert dups(spark, scratch) == {("again.png", "unique.png", "store")}
    assert spark.read.parquet(scratch + "/store").count() == 1      # known rows are not written again
    shutil.copy(os.path.join(image_dir, "identical2.png"), os.path.join(src, "more.png"))
    run(spark, scratch, src, known_dir=scratch + "/known")
    assert ("more.png", "identical1.png", "store") in dups(spark, scratch)
