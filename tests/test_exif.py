"""Camera tags from bytes: both byte orders, damaged files, and random bytes."""

import random
import struct

from pyspark.sql import functions as F

from pictorium.sources import exif as X


def tiff(order, directories, first=8):
    """directories: (offset, [(tag, type, count, raw value of any length)]) in the order of their offsets."""
    out = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", first)
    for at, entries in directories:
        out = out.ljust(at, b"\0")
        behind, rows, values = at + 2 + 12 * len(entries) + 4, b"", b""
        for tag, kind, count, raw in entries:
            rows += struct.pack(order + "HHI", tag, kind, count)
            if len(raw) <= 4:
                rows += raw.ljust(4, b"\0")
            else:
                rows += struct.pack(order + "I", behind + len(values))
                values += raw
        out += struct.pack(order + "H", len(entries)) + rows + b"\0" * 4 + values
    return out


def jpeg(part, before=b"", after=b"\xff\xda\0\x08"):
    segment = b"" if part is None else b"\xff\xe1" + struct.pack(">H", len(part) + 8) + b"Exif\0\0" + part
    return b"\xff\xd8" + before + segment + after


def sample(order, camera=100, place=300):
    n = lambda f, *v: struct.pack(order + f, *v)
    return tiff(order, [
        (8, [(271, 2, 6, b"Make\0\0"), (274, 3, 1, n("H", 6)), (0x8769, 4, 1, n("I", camera)), (0x8825, 4, 1, n("I", place)), (999, 99, 7, b"")]),
        (100, [(33434, 5, 1, n("II", 1, 250)), (37386, 10, 1, n("ii", -7, 2)), (34855, 3, 2, n("HH", 100, 200)), (36867, 2, 20, b"2018:01:31 23:59:59\0"), (33437, 5, 1, n("II", 1, 0))]),
        (300, [(1, 2, 2, b"S\0"), (2, 5, 3, n("6I", 10, 1, 30, 1, 0, 1)), (3, 2, 2, b"E\0"), (4, 5, 3, n("6I", 20, 1, 15, 1, 36, 10))]),
    ])


def test_both_byte_orders():
    for order in "<>":
        tags, problem = X.tags_of(jpeg(sample(order), before=b"\xff\xe0\0\x10JFIF\0" + b"\0" * 9 + b"\xff\xff\xff\xfe\0\x04hi"))
        assert problem is None
        assert tags == {"make": "Make", "orientation": "6", "exposure": "0.004", "focal": "-3.5", "iso_value": "100.0 200.0", "date_time_original": "2018:01:31 23:59:59", "fnumber": "nan", "lat_ref": "S", "lat": "10.0 30.0 0.0", "lon_ref": "E", "lon": "20.0 15.0 3.6"}


def test_damaged_files():
    sound = sample("<")
    assert X.tags_of(jpeg(None)) == ({}, None) and X.tags_of(jpeg(None, after=b"\xff\xd9")) == ({}, None)
    cases = {
        b"": "no picture", b"GIF89a": "no picture", b"\xff\xd8": "cut short", b"\xff\xd8abc": "no marker", b"\xff\xd8\xff\xe1\0\x01": "length too small", jpeg(sound)[:90]: "cut short",
        jpeg(b"XX*\0" + sound[4:]): "no byte order", jpeg(b"II*\0"): "no byte order", jpeg(tiff("<", [], first=8)): "offset outside", jpeg(tiff("<", [(8, [])], first=4000)): "offset outside", jpeg(tiff("<", [(8, [])], first=2)): "offset outside",
        jpeg(sample("<", camera=8)): "directory read before", jpeg(sample("<", camera=100, place=100)): "directory read before", jpeg(sample(">", camera=1 << 31)): "offset outside",
        jpeg(b"II*\0\x08\0\0\0\xff\x01" + b"\0" * 40): "entries outside", jpeg(b"II*\0\x08\0\0\0\xff\xff" + b"\0" * 40): "entries outside",
        jpeg(tiff("<", [(8, [(271, 2, 2**32 - 1, b"abcde")])])): "value too long", jpeg(tiff("<", [(8, [(271, 2, 60000, b"abcde")])])): "offset outside",
    }
    for content, why in cases.items():
        assert X.tags_of(content) == (None, why), (content[:40], why)
    assert X.tags_of(jpeg(sound)[:90], whole=False) == (None, "beyond the head")


def test_no_bytes_break_it():
    """Cut anywhere, or with any byte changed, a file gives tags or a reason."""
    rng, whole = random.Random(1), jpeg(sample(">"))
    for cut in range(len(whole)):
        X.tags_of(whole[:cut])
    for _ in range(3000):
        held = bytearray(whole)
        for _ in range(rng.randrange(1, 6)):
            held[rng.randrange(len(held))] = rng.randrange(256)
        tags, problem = X.tags_of(bytes(held))
        assert (tags is None) != (problem is None)


def test_in_spark(spark):
    rows = [(1, jpeg(sample("<"))), (2, None), (3, b""), (4, jpeg(None)), (5, jpeg(sample("<"), before=b"\xff\xfe\xff\xff" + b"x" * 0xFFFD))]
    df = spark.createDataFrame(rows, "id long, content binary")
    got = {r.id: (r.t.tags and len(r.t.tags), r.t.problem) for r in df.select("id", X.camera_tags(F.col("content")).alias("t")).collect()}
    assert got == {1: (11, None), 2: (None, None), 3: (None, "no picture"), 4: ({}, None), 5: (11, None)}
    # only the head is read
    got = {r.id: r.t.problem for r in df.select("id", X.camera_tags(F.col("content"), 4096).alias("t")).collect()}
    assert got[1] is None and got[5] == "beyond the head"


def test_only_wanted_values_are_unpacked(monkeypatch):
    """Entries that nobody asks for are checked, not unpacked; a wrong one is still a reason."""
    n = lambda f, *v: struct.pack("<" + f, *v)
    entries = [(4000 + k, 5, 2, n("4I", 1, 2, 3, 4)) for k in range(200)]
    unpacked = []
    monkeypatch.setattr(X, "unpacking", lambda *key, true=X.unpacking: unpacked.append(key) or true(*key))
    assert X.tags_of(jpeg(tiff("<", [(8, [*entries, (274, 3, 1, n("H", 6))])]))) == ({"orientation": "6"}, None)
    assert len(unpacked) == 1
    wrong = tiff("<", [(8, [*entries, (274, 3, 1, n("H", 6)), (5000, 4, 60000 // 4, b"abcde")])])
    assert X.tags_of(jpeg(wrong)) == (None, "offset outside")


def test_made_headers_hold_what_the_orders_say(spark, tmp_path):
    """Both byte orders, numbers of two and four bytes; fixed parts are no pieces of their own, and a small file is many tasks."""
    from pictorium.plans import pictures as P

    spark.sql("SELECT id AS o_orderkey, timestamp_ntz'2001-02-03 04:05:06' AS o_orderdate FROM range(4002, 4102)").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    made = P.headers(spark, str(tmp_path))
    assert "Exchange hashpartitioning(o_orderkey" in made._jdf.queryExecution().executedPlan().toString()
    pieces = P._hexadecimal(P._number(42, 2) + P._number(8, 4) + P._number(F.lit(0x0102), 2) + P._number(0xA0B0C0D0, 4), F.col("big"))
    assert [r[0] for r in spark.sql("SELECT explode(array(true, false)) AS big").select(pieces).collect()] == ["002A000000080102A0B0C0D0", "2A00080000000201D0C0B0A0"]
    for row in made.collect():
        tags, problem = X.tags_of(bytes(row.content))
        k = row.id
        if k % 11 and k % 13 and k % 17 and k % 19:
            assert problem is None and tags["make"] == f"Cam {k % 90 + 10}" and tags["iso_value"] == str(100 + k % 3000) and tags["date_time"] == "2001:02:03 04:05:06"
            assert tags["exposure"] == str(1 / (2 + k % 500)) and tags["lon"] == f"{float(k % 179)} {float(k % 59)} 15.0"


def test_each_different_fraction_is_worked_out_once(spark, monkeypatch):
    import pandas as pd

    from pictorium.sources import pictures

    asked = []
    monkeypatch.setattr(pictures, "_rational", lambda v, limit: asked.append(v) or (int(v * 2), 2))
    got = pictures.as_rational(100).func(pd.Series([0.5, None, 0.5, 2.5, 0.5]))
    assert sorted(asked) == [0.5, 2.5] and got["num"].tolist() == [1, pd.NA, 1, 5, 1] and got["denom"].isna().tolist() == [False, True, False, False, False]
