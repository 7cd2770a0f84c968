from pyspark.sql import functions as F

from neardup.functions import scalars as X


def one(spark, expr, value, schema):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


def test_format_size_units(spark):
    cases = {500: "500.0 B", 2048: "2.0 KB", 5242880: "5.0 MB", 3221225472: "3.0 GB", 0: "0.0 B",
             1024 ** 4 * 3: "3.0 TB"}
    df = spark.createDataFrame([(k,) for k in cases], "n long")
    got = {r["n"]: r["s"] for r in df.select("n", X.format_size("n").alias("s")).collect()}
    assert got == cases


def test_one_decimal_matches_python(spark):
    vals = [0.35, 0.25, 2.675, 1.45, 56.55, 1.15, 1023.95, 110.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r["x"]: r["s"] for r in df.select("x", X.one_decimal("x").alias("s")).collect()}
    assert got == {v: f"{v:.1f}" for v in vals}


def test_format_number(spark):
    assert one(spark, X.format_number("n"), 1234567, "n long") == "1,234,567"
    assert one(spark, X.format_number("n"), 1000, "n long") == "1,000"


def test_extension_rules(spark):
    cases = {"/a/b/Photo.JPG": ".jpg", "/a/.hidden": "", "/a/archive.tar.gz": ".gz", "/a/noext": "",
             "/a.b/file": "", "/x/y.": "."}
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    got = {r["path"]: r["e"] for r in df.select("path", X.extension("path").alias("e")).collect()}
    assert got == cases


def test_names_resolution_megapixels(spark):
    r = spark.createDataFrame([("/data/pics/img.jpg", 1920, 1080, 1920 * 1080)],
                              "path string, w int, h int, px long").select(
        X.filename("path").alias("f"), X.directory("path").alias("d"),
        X.resolution("w", "h").alias("r"), X.megapixels("px").alias("mp")).first()
    assert (r.f, r.d, r.r, r.mp) == ("img.jpg", "/data/pics", "1920x1080", 2.07)


def quality(spark, rows):
    df = spark.createDataFrame(rows, "path string, px long, size long, depth int")
    return [r["q"] for r in df.select(X.quality_score("px", "size", "depth", "path").alias("q")).collect()]


def test_quality_monotone_and_format_rank(spark):
    lo, hi = quality(spark, [("/a.jpg", 1_000_000, 1000, 24), ("/a.jpg", 8_000_000, 1000, 24)])
    assert hi > lo
    small, big = quality(spark, [("/a.jpg", 1_000_000, 100_000, 24), ("/a.jpg", 1_000_000, 5_000_000, 24)])
    assert big > small
    raw, jpeg = quality(spark, [("/a.CR2", 1_000_000, 1000, 24), ("/a.jpg", 1_000_000, 1000, 24)])
    assert raw > jpeg
    # caps: 50 + 30 + 10 + 100/5 = 110
    assert quality(spark, [("/a.raw", 10 ** 9, 10 ** 12, 64)]) == [110.0]
    # unknown extension ranks 50 -> 10 points; nothing else counts when zero
    assert quality(spark, [("/a.svgz", 0, 0, 0)]) == [10.0]


def test_hex_round_trip_and_guard(spark):
    h = "f" * 16 + "0" * 15 + "1" + "8" + "0" * 15 + "0123456789abcdef"
    df = spark.createDataFrame([(h,), ("zz" + h[2:],), (h[:-1],)], "h string")
    rows = df.select(X.hex_to_words("h").alias("w")).collect()
    assert rows[0]["w"] == [-1, 1, -(1 << 63), 0x0123456789ABCDEF]
    assert rows[1]["w"] is None and rows[2]["w"] is None
    back = df.limit(1).select(X.words_to_hex(X.hex_to_words("h"), 4).alias("b")).first()["b"]
    assert back == h


def test_hamming_expression(spark):
    df = spark.createDataFrame([(0, -1, 5, 3)], "a0 long, b0 long, a1 long, b1 long")
    assert df.select(X.hamming(["a0", "a1"], ["b0", "b1"]).alias("d")).first()["d"] == 64 + 2


def test_pack_bits(spark):
    df = spark.createDataFrame([(-(1 << 63), 1)], "w0 long, w1 long")
    v = df.select(X.pack_bits(["w0", "w1"], [0, 1, 127]).alias("k")).first()["k"]
    assert v == 0b101
