import os
import shutil

from neardup.operators.store import SnapshotStore, lookup
from neardup.sources.files import find_image_files
from neardup.streaming import incremental as INC


def test_available_now_stream(spark, image_dir, scratch):
    src = scratch + "/incoming"
    os.makedirs(src)
    for name in ("identical1.png", "unique.png", "notes.txt"):
        shutil.copy(os.path.join(image_dir, name), src)
    q = INC.start(spark, src, scratch + "/store", scratch + "/dups", scratch + "/ckpt")
    q.awaitTermination(120)
    store = SnapshotStore(spark, scratch + "/store")
    assert store.read().count() == 2
    # second arrival: a byte copy of a stored file and a copy within the batch
    shutil.copy(os.path.join(image_dir, "identical2.png"), src)
    shutil.copy(os.path.join(image_dir, "similar.PNG"), os.path.join(src, "s1.png"))
    shutil.copy(os.path.join(image_dir, "similar.PNG"), os.path.join(src, "s2.png"))
    q = INC.start(spark, src, scratch + "/store", scratch + "/dups", scratch + "/ckpt")
    q.awaitTermination(120)
    dups = {(os.path.basename(r.path), r.reason) for r in spark.read.parquet(scratch + "/dups").collect()}
    assert dups == {("identical2.png", "store"), ("s2.png", "batch")}
    assert store.read().count() == 5
    # a batch that is played again is no duplicate of itself, and a listing finds the streamed rows
    again = INC.analyse_batch(spark.read.format("binaryFile").load(src))
    replayed = {os.path.basename(r.path) for r in INC.exact_on_arrival(again, store.read()).collect()}
    assert "unique.png" not in replayed
    found = lookup(find_image_files(spark, src), store.read()).collect()
    assert len(found) == 5 and all(r.cached and r.file_hash for r in found)
