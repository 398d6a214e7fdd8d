"""Pixels, camera tags, matched boxes, files and versions on small cases."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pictorium.functions import vectors as X
from pictorium.operators import catalogue as C
from pictorium.operators import curation as D
from pictorium.operators import matching as M
from pictorium.schema import CANDIDATES
from pictorium.sources import files, pictures, pixels, shared
from pictorium.streaming import curation as stream


def picture(height, width, seed=1):
    return np.random.default_rng(seed).integers(1, 256, (height, width, 3)).astype(np.uint8)


def test_cuts_pad_with_black():
    p = picture(6, 8)
    for l, t, r, b in ((1, 2, 5, 4), (-2, -3, 4, 2), (5, 3, 12, 9), (20, 20, 24, 22), (0, 0, 8, 6)):
        got = pixels.cut(p, l, t, r, b)
        want = [[p[y, x].tolist() if 0 <= y < 6 and 0 <= x < 8 else [0, 0, 0] for x in range(l, r)] for y in range(t, b)]
        assert got.tolist() == want


def test_sizes_and_turns():
    p = picture(4, 6)
    assert np.array_equal(pixels.resized(p, 6, 4), p)
    assert pixels.resized(np.full((5, 7, 3), 9, np.uint8), 3, 2).tolist() == [[[9] * 3] * 3] * 2
    assert pixels.resized(p, 3, 2).shape == (2, 3, 3)
    assert np.array_equal(pixels.oriented(p, 6), np.rot90(p, -1)) and np.array_equal(pixels.oriented(p, 8), np.rot90(p)) and np.array_equal(pixels.oriented(p, 3), np.rot90(p, 2))
    assert np.array_equal(pixels.oriented(pixels.oriented(p, 5), 5), p) and np.array_equal(pixels.oriented(p, 1), p)


def test_chips(spark):
    p = picture(10, 12)
    df = spark.createDataFrame([(p.tobytes(), 12, 10, 2, -1, 8, 5), (p.tobytes(), 12, 10, 0, 0, 12, 10), (None, 12, 10, 0, 0, 1, 1), (p.tobytes(), 12, 10, None, 0, 1, 1)], "pixels binary, width int, height int, l int, t int, r int, b int")
    rows = [r.c for r in df.select(pixels.chips(6)(*df.columns).alias("c")).collect()]
    assert bytes(rows[0].pixels) == pixels.cut(p, 2, -1, 8, 5).tobytes() and (rows[0].width, rows[0].height) == (6, 6)
    assert (rows[1].width, rows[1].height) == (6, 5) and len(rows[1].pixels) == 90
    assert rows[2].pixels is None and rows[3].pixels is None


class Tags(dict):
    """Stands in for what Pillow gives of a picture."""

    def __init__(self, top, below):
        super().__init__(top)
        self.below = below

    def get_ifd(self, number):
        return self.below.get(number, {})


def test_camera_tags_of_all_directories(spark):
    found = Tags({271: " Maker\0", 274: 6, 306: "2020:01:02 03:04:05"}, {0x8769: {36867: "2019:01:02 03:04:05", 33434: 0.008, 37386: 35.0, 33437: 2.8, 34855: 200, 37385: 16, 37384: 0}, 0x8825: {1: "S", 2: (10.0, 30.0, 36.0), 3: "E", 4: (20.0, 0.0, 0.0)}})
    tags = pictures.merged_tags(found)
    assert tags["lat"] == "10.0 30.0 36.0" and tags["date_time_original"].startswith("2019")
    df = spark.createDataFrame([(tags,), ({},), ({"make": "x", "iso_value": "many", "lat": "1.0 2.0"},)], "tags map<string,string>")
    one, none, odd = df.select(*[c.alias(n) for n, c in pictures.tag_columns(F.col("tags")).items()]).collect()
    assert (one.camera_make, one.orientation, one.iso_value, one.flash_info, one.light_source) == ("Maker", 6, 200, 16, 0)
    assert (one.exposure_num, one.exposure_denom, one.focal_num, one.focal_denom, one.fnumber_num, one.fnumber_denom) == (1, 125, 35, 1, 14, 5)
    assert (round(one.gps_lat_decimal, 6), one.gps_lon_decimal, one.date_taken.year, one.date_taken_valid) == (-10.51, 20.0, 2019, True)
    assert (none.camera_make, none.orientation, none.gps_lat_decimal, none.date_taken_valid) == (None, 1, -999.0, False)
    assert (odd.camera_make, odd.iso_value, odd.gps_lon_decimal) == ("x", None, -999.0)


def test_matches_are_written_back(spark):
    faces = spark.createDataFrame([(1, 7, -3, 0, 10, 10, [0.5]), (2, 7, 50, 50, 60, 60, [0.5]), (3, 8, 1, 1, 2, 2, [0.5])], "id long, image_id long, box_left int, box_top int, box_right int, box_bottom int, face_encoding_512 array<double>")
    detected = spark.createDataFrame([(7, 4, 1, 1, 11, 11, [1.0, 2.0])], "image_id long, det_id long, l int, t int, r int, b int, embedding array<double>")
    known = faces.where("image_id = 7").select("image_id", "id", F.col("box_left").alias("l"), F.col("box_top").alias("t"), F.col("box_right").alias("r"), F.col("box_bottom").alias("b"))
    out = {r.id: r for r in M.with_matches(faces, detected, M.reconciled(known, detected), 3).collect()}
    assert (out[1].box_left, out[1].box_bottom, out[1].face_encoding_512) == (1, 11, [1.0, 2.0])
    assert (out[2].box_left, out[2].face_encoding_512) == (50, [-999.0] * 3) and out[3].face_encoding_512 == [0.5]


def test_files_of_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3) for i in range(300)], "id long, person_id long")
    files.write_by_person(rows, str(tmp_path / "p"))
    folders = sorted((tmp_path / "p").glob("person_id=*"))
    assert len(folders) == 3 and all(1 <= len(list(f.glob("part-*"))) <= 8 for f in folders)
    good, bad = files.split_valid(rows, small=F.col("id") < 10, even=F.col("id") % 2 == 0)
    assert good.count() == 5 and bad.columns[-1] == "failed" and bad.where("id = 11").first().failed == ["small", "even"]
    assert json.loads(files.as_json(rows).first().body) == {"id": 0, "person_id": 0}
    here = files.with_existence(spark.createDataFrame([("/a",), (None,), ("/b",)], "f string"), "f", spark.createDataFrame([("/a",)], "path string"))
    assert {(r.f, r.exists) for r in here.collect()} == {("/a", True), (None, False), ("/b", False)}


def test_scaled_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.0, 1.0], [2.0, 0.0])], "v array<double>, mean array<double>, dev array<double>")
    row = df.select(X.standardised(F.col("v"), F.col("mean"), F.col("dev")).alias("s"), X.pixel_scaled(F.array(F.lit(127.5), F.lit(255.5))).alias("p")).first()
    assert row.s == [0.5, None] and row.p == [0.0, 1.0]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        shared.shared_root(Session())


def test_tables_go_when_dropped(spark):
    began = shared.mark()
    first, second = shared.written(spark.range(3)), shared.written(spark.range(4))
    path = Path(second.inputFiles()[0].removeprefix("file://")).parent
    shared.dropped(spark, began, keep=1)
    assert path.exists() and shared.mark() == began + 1 and second.count() == 4
    with pytest.raises(Exception):
        first.count()
    shared.dropped(spark, began)
    assert not path.exists()


FACE = f"id long, declared_person_id long, validated boolean, written_to_photo_metadata boolean, candidates {CANDIDATES}, rejected_ids array<bigint>"
OPS = "seq long, face_id_list array<bigint>, operation string, current_person_id long"


def test_batches_rewrite_their_buckets_alone(spark, tmp_path):
    table = stream.FaceTable(spark, str(tmp_path / "faces"), 8)
    table.start(spark.createDataFrame([(i, 0, False, False, [], None) for i in range(100)], FACE))
    step = table.apply(D.Marks(0, 1, 2))
    batches = [spark.createDataFrame([(n, [n, 50 + n], "confirm_proposed", 10 + n)], OPS) for n in range(4)]
    for n, batch in enumerate(batches):
        step(batch, n)
        step(batch, n)  # a batch that comes again does no harm
    declared = {r.id: r.declared_person_id for r in table.read(3).collect()}
    assert declared == {i: 0 for i in range(100)} | {n: 10 + n for n in range(4)} | {50 + n: 10 + n for n in range(4)}
    versions = table.listed(3)
    assert len(versions) == 8 and set(versions.values()) - {-1}
    kept = {(int(p.name.removeprefix("bucket=")), int(p.parent.name[1:])) for p in (tmp_path / "faces").glob("v*/bucket=*")}
    assert kept == set(versions.items()) | set(table.listed(2).items())
    step(spark.createDataFrame([], OPS), 4)
    assert table.listed(4) == versions and table.read(4).count() == 100


def test_refusals(spark):
    ops = spark.createDataFrame([(1, [1], "verify_face", None), (2, [1], "nonsense", 1), (3, [], "verify_face", None), (4, None, "verify_face", None), (5, [1], "close_assigned", None), (6, [1], None, None)], OPS)
    assert [r.refused for r in D.refusals(ops).orderBy("seq").collect()] == [None, "no such operation", "no faces", "no faces", "no person", "no such operation"]


def test_single_faces(spark):
    faces = spark.createDataFrame([(1, 0, True, True, [(5, 0.5)], None), (2, 7, True, True, [], None)], FACE)
    assert [r.declared_person_id for r in D.face_ignored(faces, 1, "hard", D.Marks(0, 1, 2)).orderBy("id").collect()] == [2, 7]
    with pytest.raises(ValueError):
        D.face_ignored(faces, 1, "some", D.Marks(0, 1, 2))
    rows = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9)], "id long, weight double")
    assert tuple(C.first_and_last(rows, "weight").first()) == (2, 1, True)
    assert [(r.id, r.total, r.has_next) for r in C.counted_page(rows, 1, 1).collect()] == [(2, 3, True)]


def test_another_threads_tables_stay(spark):
    """What another query writes between a mark and its deletion isn't deleted with it."""
    import threading

    theirs = []
    began = shared.mark()
    mine = shared.written(spark.range(3))
    thread = threading.Thread(target=lambda: theirs.append(shared.written(spark.range(5))))
    thread.start()
    thread.join()
    shared.dropped(spark, began)
    assert theirs[0].count() == 5
    with pytest.raises(Exception, match="not exist|FAILED_READ|PATH_NOT_FOUND"):
        mine.count()
