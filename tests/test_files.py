import os

import pytest
from neardup.sources import files as FS
from pyspark.sql import functions as F

from neardup.plans.dataflow import find_duplicates
from neardup.session import cut_lineage


def test_discovery_filters_extensions_and_recurses(spark, image_dir):
    paths = {os.path.basename(r.path) for r in FS.find_image_files(spark, image_dir).collect()}
    assert paths == {"identical1.png", "identical2.png", "similar.PNG", "unique.png", "other.png", "corrupted.png"}
    top = {os.path.basename(r.path) for r in FS.find_image_files(spark, image_dir, recursive=False).collect()}
    assert "other.png" not in top and "identical1.png" in top


def test_empty_directory(spark, scratch):
    os.makedirs(scratch + "/empty/x")
    with open(scratch + "/empty/x/readme.txt", "w") as f:
        f.write("x")
    assert FS.find_image_files(spark, scratch + "/empty").count() == 0


def test_content_hash(spark, image_dir):
    h = {os.path.basename(r.path): r.file_hash for r in FS.content_hashes(spark, image_dir).collect()}
    assert h["identical1.png"] == h["identical2.png"] and len(h["identical1.png"]) == 64
    assert h["unique.png"] != h["identical1.png"]


def test_analyze_and_phash(spark, image_dir):
    m = FS.analyze(spark, image_dir)
    rows = {os.path.basename(r.path): r for r in m.collect()}
    assert rows["corrupted.png"].error is not None and rows["corrupted.png"].quality_score == 0.0
    assert rows["corrupted.png"].file_hash is not None        # hashed before decoding
    assert (rows["identical1.png"].width, rows["identical1.png"].height) == (128, 128)
    assert rows["other.png"].pixel_count == 120 * 80 and rows["other.png"].bit_depth == 24
    assert len(rows["identical1.png"].perceptual_hash) == 64

    def dist(a, b):
        return sum(bin((x ^ y) & ((1 << 64) - 1)).count("1") for x, y in zip(rows[a].fp, rows[b].fp))

    assert dist("identical1.png", "identical2.png") == 0
    assert dist("identical1.png", "similar.PNG") <= 10        # resized and re-encoded
    assert dist("identical1.png", "unique.png") > 40


def test_only_changed_files_are_analysed_again(spark, image_dir):
    first = FS.analyze(spark, image_dir).withColumn("analysis_version", F.lit(1))
    store = cut_lineage(first)
    os.utime(os.path.join(image_dir, "unique.png"), (2_000_000_000, 2_000_000_000))
    hits, new = FS.analyze_new(spark, image_dir, store)
    assert {os.path.basename(r.path) for r in new.collect()} == {"unique.png"}
    assert hits.count() == store.count() - 1


def test_types_without_decoder_keep_their_hash(spark, image_dir):
    for name in ("a.tga", "b.tga"):
        with open(os.path.join(image_dir, name), "wb") as f:
            f.write(b"not decoded here")
    with open(os.path.join(image_dir, "wrong.jpg"), "wb") as f, open(os.path.join(image_dir, "unique.png"), "rb") as g:
        f.write(g.read())
    m = FS.analyze(spark, image_dir)
    rows = {os.path.basename(r.path): r for r in m.collect()}
    assert rows["a.tga"].error is None and rows["a.tga"].file_hash == rows["b.tga"].file_hash
    assert rows["wrong.jpg"].format == "PNG" and sorted(r.id for r in rows.values()) == list(range(1, len(rows) + 1))
    exact = {os.path.basename(r.path) for r in find_duplicates(m, mode="exact_only").collect()}
    assert {"a.tga", "b.tga"} <= exact


def test_files_end_to_end(spark, image_dir):
    m = FS.analyze(spark, image_dir)
    g = find_duplicates(m, threshold=10)
    groups = {}
    for r in g.collect():
        groups.setdefault(r.match_type, set()).add(os.path.basename(r.path))
    assert groups["exact"] == {"identical1.png", "identical2.png"}
    # both exact members leave the similarity stage, so the resized copy has no partner
    assert "perceptual" not in groups
    p = find_duplicates(m, threshold=10, mode="perceptual_only")
    names = {os.path.basename(r.path) for r in p.collect()}
    assert names == {"identical1.png", "identical2.png", "similar.PNG"}
