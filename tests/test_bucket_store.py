import datetime as dt

from neardup.operators import store as ST
from neardup.operators.bucket_store import BucketStore
from test_store import T0, listing_rows, store_rows


def rows_of(df):
    return sorted((r.path, r.mtime, r.quality_score) for r in df.collect())


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_moves_the_listing_only(spark, scratch):
    store = BucketStore(spark, scratch + "/s", store_rows(spark).schema, buckets=4)
    store.append(store_rows(spark), 1)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits, misses = ST.split_hits(listing_rows(spark), store.read())
        assert {r.path for r in hits.collect()} == {"/d/a.png", "/d2/c.png"}
        assert {r.path for r in misses.collect()} == {"/d/b.png", "/d/new.png"}
        for part in (hits, misses):
            plan = final_plan(part).split("== Initial Plan ==")[0]
            assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
        # reading the live rows needs no exchange either
        assert "Exchange" not in final_plan(store.read())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_replace_remove_replay_and_attach(spark, scratch):
    store = BucketStore(spark, scratch + "/s", store_rows(spark).schema, buckets=3)
    assert store.read().count() == 0
    store.append(store_rows(spark), 1)
    better = store_rows(spark).where("path = '/d/a.png'").replace(1.0, 9.0, ["quality_score"])
    store.append(better, 2)
    store.append(better, 2)                                   # a replayed batch
    assert store.read().count() == 4 and store.read().where("path = '/d/a.png'").first().quality_score == 9.0
    store.remove(store.read().where("path LIKE '/d/%'"), 3)
    assert rows_of(store.read()) == [("/d2/c.png", T0, 3.0)]
    store.append(better, 4)                                   # comes back after its deletion
    assert len(rows_of(store.read())) == 2
    before = rows_of(store.read())
    store.drop()                                              # another session: attached by its folder
    again = BucketStore(spark, scratch + "/s")
    assert rows_of(again.read()) == before
    other = BucketStore(spark, scratch + "/other", store_rows(spark).schema, buckets=2)
    other.append(again.read(), 0)                             # compaction: the live rows into a new store
    assert rows_of(other.read()) == before and other.file_stats().first().rows == 2
    assert again.file_stats().first().bytes > 0


def test_versions_are_kept_apart(spark, scratch):
    store = BucketStore(spark, scratch + "/s", store_rows(spark).schema, buckets=2)
    row = store_rows(spark).limit(1)
    store.append(row, 1)
    store.append(row.replace(1, 2, ["analysis_version"]), 2)
    assert store.read().count() == 2
    store.remove(store.read().where("analysis_version = 1"), 3)
    assert [r.analysis_version for r in store.read().collect()] == [2]
    assert store.read().first().created_at == T0 < T0 + dt.timedelta(days=1)
