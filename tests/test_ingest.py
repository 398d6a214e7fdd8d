"""The decision table, dates and places, on literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from pictorium.functions import values as V
from pictorium.operators import catalogue as C
from pictorium.operators import ingest as I
from pictorium.sources.shared import numbered

FILES = "path string, is_file boolean, modified double, pixel_hash string, orientation int"
IMAGES = "id long, filename string, pixel_hash string, orientation int, date_modified double"


def decide(spark, files, images, duplicates=(), listing=None):
    f, i = spark.createDataFrame(files, FILES), spark.createDataFrame(images, IMAGES)
    d = spark.createDataFrame([(x,) for x in duplicates], "filename string")
    here = spark.createDataFrame([(x,) for x in (listing if listing is not None else [r[0] for r in files])], "path string")
    return {r.path: (r.action, r.image_id) for r in I.decisions(f, i, d, here).collect()}


def test_decision_table(spark):
    images = [(1, "/a.jpg", "h1", 1, 5.0), (2, "/b.jpg", "h2", 1, 5.0), (3, "/c.jpg", "h3", 1, 5.0), (4, "/d.jpg", "h4", 1, 5.0), (5, "/twice.jpg", "h5", 1, 5.0), (6, "/twice.jpg", "h5", 1, 5.0), (7, "/gone.jpg", "m1", 1, 5.0), (8, "/gone2.jpg", "m2", 1, 5.0), (9, "/here2.jpg", "m2", 1, 5.0), (10, "/here3.jpg", "m3", 1, 5.0), (11, "/x.jpg", "m4", 1, 5.0), (12, "/y.jpg", "m4", 1, 5.0)]
    files = [("/no.jpg", False, 1.0, "z", 1), ("/a.png", True, 1.0, "z", 1), ("/dup.jpg", True, 1.0, "z9", 1), ("/twice.jpg", True, 6.0, "h5", 1), ("/a.jpg", True, 5.0, "h1", 1), ("/b.jpg", True, 6.0, "h2", 1), ("/c.jpg", True, 6.0, "h3", 6), ("/d.jpg", True, 6.0, "other", 1), ("/new1.jpg", True, 6.0, "m1", 1), ("/new2.jpg", True, 6.0, "m2", 1), ("/new3.jpg", True, 6.0, "m3", 1), ("/new4.jpg", True, 6.0, "m4", 1), ("/new5.JPEG", True, 6.0, "fresh", 1)]
    listing = [f[0] for f in files] + ["/here2.jpg", "/here3.jpg", "/x.jpg", "/y.jpg"]
    assert decide(spark, files, images, ["/dup.jpg"], listing) == {
        "/no.jpg": ("skip_missing", None), "/a.png": ("skip_name", None), "/dup.jpg": ("drop_duplicate", None), "/twice.jpg": ("error_repeated", None),
        "/a.jpg": ("unchanged", 1), "/b.jpg": ("touch", 2), "/c.jpg": ("replace_turned", 3), "/d.jpg": ("replace_pixels", 4), "/new1.jpg": ("move", 7), "/new2.jpg": ("move_first", 8),
        "/new3.jpg": ("insert_duplicate", None), "/new4.jpg": ("insert", None), "/new5.JPEG": ("insert", None),
    }


def test_equal_files_of_one_batch(spark):
    files = [(f"/{n}.jpg", True, 1.0, "same", 1) for n in "abc"]
    assert [decide(spark, files, [])[f"/{n}.jpg"][0] for n in "abc"] == ["insert", "insert_duplicate", "insert"]


def test_one_vanished_twin_goes_to_one_file(spark):
    files = [(f"/{n}.jpg", True, 1.0, "same", 1) for n in "ab"]
    got = decide(spark, files, [(1, "/gone.jpg", "same", 1, 0.0)])
    assert got == {"/a.jpg": ("move", 1), "/b.jpg": ("insert_duplicate", None)}


def test_a_second_run_changes_nothing(spark):
    files = spark.createDataFrame([(f"/d/{n}.jpg", True, 1.0, f"h{n}", 1) for n in "abc"], FILES)
    images = spark.createDataFrame([(1, "/d/gone.jpg", "hb", 1, 0.0)], IMAGES).withColumn("is_processed", F.lit(True))
    none, here = spark.createDataFrame([], "filename string"), files.select("path")
    directories = spark.createDataFrame([(3, "/d")], "id long, dir_path string")
    after, duplicates = I.applied(images, files, I.decisions(files, images, none, here), directories)
    assert duplicates.count() == 0
    fresh = I.new_ids(after.where("id is null").drop("id"), 1, ("filename",))
    full = after.where("id is not null").unionByName(fresh.select(*after.columns))
    assert {(r.id, r.filename, r.is_processed) for r in full.collect()} == {(1, "/d/b.jpg", True), (2, "/d/a.jpg", False), (3, "/d/c.jpg", False)}
    assert {r.action for r in I.decisions(files, full, none, here).collect()} == {"unchanged"}


def test_ids_without_gaps_or_repeats(spark):
    """Two million rows in 64 partitions, with adaptive execution and without: every row, every number once."""
    n = 2_000_000
    rows = spark.range(0, n, 1, 64).select(F.concat(F.lit("/p/"), F.md5(F.col("id").cast("string").cast("binary"))).alias("filename"))
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        got = I.new_ids(rows, 100, ("filename",)).agg(F.count("*").alias("n"), F.count_distinct("id").alias("different"), F.min("id").alias("low"), F.max("id").alias("high")).first()
        assert tuple(got) == (n, n, 101, 100 + n)
    spark.conf.set("spark.sql.adaptive.enabled", kept)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    few = I.new_ids(rows.limit(5000), 0, ("filename",)).orderBy("filename").collect()
    assert [r.id for r in few] == [*range(1, 5001)]


def test_numbers_within_groups(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else "hot", i, i % 4 == 0) for i in range(3000)] + [("b", -1, True)], "k string, i long, counted boolean")
    got = {(r.k, r.i): r.number for r in numbered(rows, [F.desc("i")], ["k"]).collect()}
    for k in (None, "hot", "b"):
        own = sorted((i for q, i in got if q == k), reverse=True)
        assert [got[k, i] for i in own] == [*range(1, len(own) + 1)]
    counted = {(r.k, r.i): r.number for r in numbered(rows, ["i"], ["k"], counts=F.col("counted")).collect()}
    assert counted["hot", 2999] == sum(i % 4 == 0 and i % 3 != 0 for i in range(3000))


def test_missing_directories(spark):
    paths = spark.createDataFrame([("/a/x.jpg",), ("/a/y.jpg",), ("/b/c/z.jpg",)], "path string")
    assert [r.dir_path for r in I.missing_directories(paths, spark.createDataFrame([("/a",)], "dir_path string")).collect()] == ["/b/c"]


def test_image_names(spark):
    names = ["/a.jpg", "/a.JPG", "/a.jpeg", "/a.JpEg", "/a.|pg", "/a.png", "/a.jpg.txt", "/jpg", "/.a/b.jpg", "/a/.b.jpg"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert {r.path for r in df.where(V.is_image(F.col("path"))).collect()} == {*names[:5], *names[8:]}
    assert {r.path for r in I.listed(df).collect()} == {*names[:5]}


def test_camera_dates(spark):
    good = dt.datetime(2018, 1, 31, 23, 59, 58)
    cases = [(None, None), ("", None), ("   ", None), ("0000:00:00 00:00:00", None), (" 2018:01:31 23:59:58", None), ("2018:01:31 23:59:58\0", good), ("2018-01-31 23:59:58", good), ("2018:01:31 23:59:58", good), ("rubbish", None), ("2018:13:41 23:59:58", None), ("2018-01-31T23:59:58", good), ("2018-02-01T01:59:58+02:00", good), ("2018-01-31T23:59:58.75Z", good), ("31 January 2018 23:59:58", good), ("31 Jan 2018 23:59:58", good), ("2018/01/31 23:59:58", good), ("January 31, 2018", good.replace(hour=0, minute=0, second=0))]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, s string")
    assert [r.d for r in df.select("k", V.exif_date(F.col("s")).alias("d")).orderBy("k").collect()] == [c[1] for c in cases]


def test_places(spark):
    nan = float("nan")
    rows = [([10.0, 30.0, 36.0], "N", [20.0, 0.0, 0.0], "E"), ([10.0, 30.0, 36.0], "S", [20.0, 15.0, 0.0], "W"), (None, "N", [1.0, 1.0, 1.0], "E"), ([1.0, nan, 0.0], "N", [2.0, 0.0, nan], "E")]
    df = spark.createDataFrame(rows, "a array<double>, ar string, b array<double>, br string")
    y, x = V.gps_pair(F.col("a"), F.col("ar"), F.col("b"), F.col("br"))
    got = [(round(r.y, 6), round(r.x, 6)) for r in df.select(y.alias("y"), x.alias("x")).collect()]
    assert got == [(10.51, 20.0), (-10.51, -20.25), (-999.0, -999.0), (1.0, 2.0)]


def test_robust_dates(spark):
    at = lambda s: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=s)
    base = 1577836800.0
    rows = [(1, at(0), True), (1, at(10), True), (1, at(20), True), (1, at(9999), True), (2, at(5), True), (2, at(5), True), (2, at(500), True), (3, at(1), False), (4, at(7), True)]
    images = spark.createDataFrame(rows, "directory_id long, date_taken timestamp_ntz, date_taken_valid boolean")
    got = {r.directory_id: (r.mean_datesec - base, r.first_datesec - base, r.n_used) for r in C.robust_dates(images, now=base + 1).collect()}
    assert got == {1: (10.0, 0.0, 3), 2: (170.0, 5.0, 3), 3: (1.0, 1.0, 0), 4: (7.0, 7.0, 1)}
