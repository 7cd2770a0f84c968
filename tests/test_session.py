import time

from pyspark.sql import functions as F

from neardup.session import SHUFFLE_CLEANUP, cut_lineage


def shuffle_files(spark) -> set[str]:
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    rows = spark.range(20_000).withColumn("k", F.col("id") % 999)
    table = cut_lineage(rows.groupBy("k").agg(F.max("id").alias("m")).join(rows.repartition(5, "id"), "k"))
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert table.count() == 20_000 and table.agg(F.sum("m")).first()[0] == sum(
        max(range(i % 999, 20_000, 999)) for i in range(20_000))
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting


def test_the_setting_comes_back_after_a_failed_write(spark):
    setting = spark.conf.get(SHUFFLE_CLEANUP, None)
    try:
        cut_lineage(spark.range(5).select(F.raise_error(F.lit("no")).cast("int").alias("x")))
    except Exception as e:
        assert "no" in str(e)
    else:
        raise AssertionError("the write did not fail")
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting
