from pyspark.sql import Window, functions as F

from neardup.operators.ranking import global_index, rank_in_group


def test_global_index_gap_free(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = global_index(df, ["k"], "idx", start=5).collect()
    assert sorted(r.idx for r in rows) == list(range(5, 1005))
    assert all(r.idx == r.k + 5 for r in rows)


def test_rank_in_group_paths_agree(spark):
    df = spark.range(0, 600).select((F.col("id") % 3).alias("g"), (F.col("id") * 31 % 600).alias("v"))
    w = Window.partitionBy("g").orderBy(F.col("v").desc())
    expect = {(r.g, r.v): r.r for r in df.withColumn("r", F.row_number().over(w)).collect()}
    windowed = rank_in_group(df, ["g"], [F.col("v").desc()], "r")
    spread = rank_in_group(df, ["g"], [F.col("v").desc()], "r", max_window_rows=0)
    assert {(r.g, r.v): r.r for r in windowed.collect()} == expect
    assert {(r.g, r.v): r.r for r in spread.collect()} == expect
