"""Box geometry against plain re-computations."""

import random

from pyspark.sql import functions as F

from pictorium.functions import boxes as B
from pictorium.operators import matching as M


def iou(x, y):
    w, h = min(x[2], y[2]) - max(x[0], y[0]), min(x[3], y[3]) - max(x[1], y[1])
    both = max(w, 0) * max(h, 0)
    whole = (x[2] - x[0]) * (x[3] - x[1]) + (y[2] - y[0]) * (y[3] - y[1]) - both
    return both / whole if whole else 0.0


def greedy(rows, threshold):
    kept = []
    for row in sorted(rows, key=lambda r: (-r[1], r[0])):
        if all(iou(row[2:], k[2:]) <= threshold for k in kept):
            kept.append(row)
    return {r[0] for r in kept}


def test_non_maximum_as_the_greedy_loop(spark):
    rng = random.Random(5)
    rows = []
    for image in range(6):
        for i in range(25):
            l, t = rng.randrange(100), rng.randrange(100)
            rows.append((image, image * 100 + i, rng.choice([0.3, 0.5, 0.9]), l, t, l + rng.randrange(5, 60), t + rng.randrange(5, 60)))
    df = spark.createDataFrame(rows, "image_id long, det_id long, score double, l int, t int, r int, b int")
    for threshold in (0.1, 0.3):
        got = {r.det_id for r in M.non_maximum(df, threshold).collect()}
        want = set().union(*[greedy([r[1:] for r in rows if r[0] == image], threshold) for image in range(6)])
        assert got == want


def test_a_suppressed_box_suppresses_nothing(spark):
    rows = [(1, 1, 0.9, 0, 0, 10, 10), (1, 2, 0.8, 4, 0, 14, 10), (1, 3, 0.7, 8, 0, 18, 10)]
    df = spark.createDataFrame(rows, "image_id long, det_id long, score double, l int, t int, r int, b int")
    assert {r.det_id for r in M.non_maximum(df, 0.3).collect()} == {1, 3}


def sides(spark, known, found):
    return spark.createDataFrame(known, "image_id long, id long, l int, t int, r int, b int"), spark.createDataFrame(found, "image_id long, det_id long, l int, t int, r int, b int")


def matched(spark, known, found, **more):
    return {(r.existing_id, r.det_id, r.action) for r in M.reconciled(*sides(spark, known, found), **more).collect()}


def test_matching(spark):
    assert matched(spark, [(1, 1, 0, 0, 10, 10)], [(1, 7, 1, 1, 11, 11)]) == {(1, 7, "update")}
    assert matched(spark, [(1, 1, 0, 0, 10, 10)], [(1, 7, 50, 50, 60, 60)]) == {(1, None, "unmatched"), (None, 7, "new")}
    assert matched(spark, [(1, 1, 0, 0, 10, 10)], []) == {(1, None, "unmatched")}
    assert matched(spark, [], [(1, 7, 0, 0, 10, 10)]) == {(None, 7, "new")}
    # two detections: the nearer middle wins, and the other isn't new
    assert matched(spark, [(1, 1, 0, 0, 20, 20)], [(1, 7, 4, 4, 24, 24), (1, 8, 1, 1, 21, 21)]) == {(1, 8, "update")}
    # two known boxes may share a detection
    two = [(1, 1, 0, 0, 20, 20), (1, 2, 2, 2, 22, 22)], [(1, 7, 2, 2, 22, 22)]
    assert matched(spark, *two) == {(1, 7, "update"), (2, 7, "update")}
    assert matched(spark, *two, exclusive=True) == {(2, 7, "update"), (1, None, "unmatched")}


def test_distance_iou_of_equal_boxes(spark):
    known, found = sides(spark, [(1, 1, 0, 0, 10, 10)], [(1, 7, 0, 0, 10, 10)])
    assert M.overlaps(known, found).first().diou == 1.0


def test_tiles_cover_the_image(spark):
    df = spark.createDataFrame([(1, 900, 600), (2, 101, 77)], "id long, width int, height int")
    rows = M.tiled(df).collect()
    for image, w, h in ((1, 900, 600), (2, 101, 77)):
        own = [r for r in rows if r.id == image]
        assert len(own) == 10 and sorted(r.tile_no for r in own) == list(range(10))
        thirds = [r for r in own if r.cut == 3]
        assert all(any(r.l <= x < r.r and r.t <= y < r.b for r in thirds) for x in range(0, w, 7) for y in range(0, h, 7))
        assert all(0 <= r.l < r.r <= w and 0 <= r.t < r.b <= h for r in own)


def test_padded_chip_off_the_image(spark):
    df = spark.createDataFrame([(500, 0, 520, 10), (0, 0, 10, 10)], "l int, t int, r int, b int")
    got = [r.x is None for r in df.select(B.padded_chip(B.Box.of(), F.lit(100), F.lit(100), 0.4, 800).alias("x")).collect()]
    assert got == [True, False]


def test_padded_chip_names_its_box_once(spark):
    """What a step computes is named by the next ones, not repeated in them."""
    df = spark.createDataFrame([(10, 10, 90, 40)], "l int, t int, r int, b int")
    out = df.select(B.padded_chip(B.Box.of(), F.lit(100), F.lit(100), 0.4, 60).alias("x"))
    row = out.first().x
    assert tuple(row) == (0, 0, 100, 52, 6, 6, 54, 24, 60, 31)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("greatest") < 8 and plan.count("least") < 8
