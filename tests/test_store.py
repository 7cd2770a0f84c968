import datetime as dt

import pytest

from pyspark.sql import functions as F

from neardup.operators import store as ST

T0 = dt.datetime(2024, 1, 1)


def store_rows(spark):
    rows = [("/d/a.png", T0, 100, 1.0, 1, T0, T0), ("/d/b.png", T0, 200, 2.0, 1, T0, T0 - dt.timedelta(days=40)),
            ("/d2/c.png", T0, 300, 3.0, 1, T0, T0), ("/d/old.png", T0, 50, 0.5, 1, T0, T0)]
    return spark.createDataFrame(rows, "path string, mtime timestamp, file_size long, quality_score double, "
                                       "analysis_version int, created_at timestamp, last_accessed timestamp")


def listing_rows(spark):
    rows = [("/d/a.png", T0, 100), ("/d/b.png", T0 + dt.timedelta(seconds=5), 200), ("/d/new.png", T0, 10),
            ("/d2/c.png", T0, 300)]
    return spark.createDataFrame(rows, "path string, mtime timestamp, file_size long")


def test_hit_rate_values(spark):
    st = store_rows(spark)
    r = ST.hit_rate(listing_rows(spark), st).first()
    assert (r.cache_hits, r.cache_misses, r.total_files, r.hit_rate) == (2, 2, 4, 50.0)
    empty = listing_rows(spark).limit(0)
    r = ST.hit_rate(empty, st).first()
    assert (r.cache_hits, r.total_files, r.hit_rate) == (0, 0, 0.0)


def test_split_and_upsert_replace_changed(spark):
    st, li = store_rows(spark), listing_rows(spark)
    hits, misses = ST.split_hits(li, st)
    assert {r.path for r in hits.collect()} == {"/d/a.png", "/d2/c.png"}
    assert {r.path for r in misses.collect()} == {"/d/b.png", "/d/new.png"}
    new = (misses.withColumn("quality_score", F.lit(9.0)).withColumn("analysis_version", F.lit(1))
           .withColumn("created_at", F.lit(T0)).withColumn("last_accessed", F.lit(T0)))
    snap = ST.upsert(st, new)
    # the changed file's old version stays until evicted (keyed by path+mtime+size)
    assert snap.count() == 6
    assert snap.where("path = '/d/b.png'").count() == 2


def test_touch_invalidate_prefix_stale_missing(spark):
    st, li = store_rows(spark), listing_rows(spark)
    hits, _ = ST.split_hits(li, st)
    now = dt.datetime(2024, 2, 1)
    touched = {r.path: r.last_accessed for r in ST.touch(st, hits, now).collect()}
    assert touched["/d/a.png"] == now and touched["/d/b.png"] == T0 - dt.timedelta(days=40)
    assert {r.path for r in ST.invalidate_prefix(st, "/d").collect()} == {"/d2/c.png"}
    assert {r.path for r in ST.invalidate_prefix(st, "/d/").collect()} == {"/d2/c.png"}
    kept = {r.path for r in ST.evict_stale(st, T0, 30).collect()}
    assert kept == {"/d/a.png", "/d2/c.png", "/d/old.png"}
    assert {r.path for r in ST.evict_missing(st, li).collect()} == {"/d/a.png", "/d/b.png", "/d2/c.png"}
    gone = ST.invalidate(st, spark.createDataFrame([("/d/a.png",)], "path string"))
    assert gone.count() == 3


def test_snapshot_store(spark, scratch):
    s = ST.SnapshotStore(spark, scratch + "/store")
    assert s.read() is None
    first = s.write(store_rows(spark))
    assert s.current() == first and s.read().count() == 4
    st = s.disk_stats().first()
    assert st.total_entries == 4 and st.files >= 1 and st.bytes > 0
    second = s.write(ST.invalidate_prefix(s.read(), "/d"))
    assert s.current() == second and s.read().count() == 1
    s.append(store_rows(spark).where("path = '/d/a.png'"))
    assert len(s.parts()) == 2 and s.read().count() == 2
    s.compact(1)
    assert len(s.parts()) == 1 and s.drop_old() == 3 and s.read().count() == 2
    # a crash after the part is written and before its list: the old list still counts
    before = s.parts()
    s._new_part(store_rows(spark), None)
    assert s.parts() == before and s.read().count() == 2
    # of two writers that started from one list, the second fails
    version = s._version()
    s._point(before, version)
    with pytest.raises(RuntimeError):
        s._point(before, version)
    s.clear()
    assert s.read().count() == 0


def test_access_log_keeps_touched_rows(spark, scratch):
    st, li = store_rows(spark), listing_rows(spark)
    log = ST.SnapshotStore(spark, scratch + "/access")
    hits, _ = ST.split_hits(li, st)
    log.append(ST.access_rows(hits, T0 + dt.timedelta(days=50)))
    now = T0 + dt.timedelta(days=60)
    kept = {r.path for r in ST.evict_stale(st, now, 30, log.read()).collect()}
    assert kept == {"/d/a.png", "/d2/c.png"}          # touched on day 50; the others are older
    assert {r.path for r in ST.evict_stale(st, now, 30).collect()} == set()
