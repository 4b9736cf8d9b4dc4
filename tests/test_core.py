"""Goldens, edge cases and byte fixtures of the reference semantics."""

import csv
import datetime as dt
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidegap.functions import exif as X
from tidegap.functions.paths import basename, data_uri_bytes, dirname
from tidegap.functions.timestamps import filename_date, resolve_timestamp, strftime
from tidegap.operators import copying, diff, layout, ordering, sessions
from tidegap.operators.gaps import undated, with_t_ms
from tidegap.operators.ordering import progressive_order
from tidegap.operators.ranged import with_index
from tidegap.params import Params, unit_ms
from tidegap.plans.pipeline import albums, photo_albums, summary
from tidegap.plans.queries import sample_jpeg
from tidegap.sources import files
from tidegap.streaming import recompute

T0 = dt.datetime(2015, 8, 15, 12, 0)


def at(spark, seconds, key=0):
    rows = [(key, i, T0 + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "k int, id int, ts timestamp_ntz")


def sizes(spark, seconds, params=Params()):
    out = albums(at(spark, seconds), ["k"], "id", params=params)
    return [r["n_photos"] for r in out.orderBy("album_id").collect()]


def sample_dates(path):
    """Four bursts of a sample of 572 photos, in reverse order, as EXIF-style text."""
    bursts = [("15 12:44:41", 94, 2400), ("15 14:30:00", 262, 23472), ("16 09:34:32", 33, 2910), ("16 16:43:10", 171, 17687), ("17 07:36:26", 12, 2631)]
    rows = []
    for start, n, long in bursts:
        first = dt.datetime.strptime(f"2015-08-{start}", "%Y-%m-%d %H:%M:%S")
        rows += [first + dt.timedelta(seconds=i * long // (n - 1)) for i in range(n)]
    path.write_text("".join(f"{r:%Y:%m:%d %H:%M:%S}\n" for r in reversed(rows)) + "0000:00:00 00:00:00\n")
    return rows


def test_sample_dates(spark, tmp_path):
    want = sample_dates(tmp_path / "dates.csv")
    raw = files.read_dates(spark, str(tmp_path / "dates.csv"))
    assert raw.columns == ["raw", "ts"] and undated(raw).count() == 1
    rows = raw.withColumn("id", F.monotonically_increasing_id()).withColumn("k", F.lit(0))
    got = [(r["start"], r["end"], r["n_photos"], r["name"]) for r in albums(rows, ["k"], "id").orderBy("album_id").collect()]
    assert [g[2:] for g in got] == [(356, "2015_08Aug_15_Album_1"), (33, "2015_08Aug_16_Album_2"), (171, "2015_08Aug_16_Album_3"), (12, "2015_08Aug_17_Album_4")]
    assert got[0][0] == dt.datetime(2015, 8, 15, 12, 44, 41) and got[3][1] == dt.datetime(2015, 8, 17, 8, 20, 17)
    for unit, n in (("days", 1), ("hours", 5), ("seconds", len(set(want)))):
        p = Params(auto=False, separation=1, unit=unit)
        assert albums(rows, ["k"], "id", params=p).count() == n
        assert sessions.assign_global(with_t_ms(rows), "id", p, 5).select("album_id").distinct().count() == n


def brute_albums(rows, auto=True, limit=0):
    """Albums of (key, id, ms) rows by loops and whole numbers."""
    out = {}
    for key in {k for k, _, _ in rows}:
        mine = sorted((t, i) for k, i, t in rows if k == key)
        gaps = [b[0] - a[0] for a, b in zip(mine, mine[1:])]
        n, s, q, album = len(gaps), sum(gaps), sum(g * g for g in gaps), 0
        out[key, mine[0][1]] = (None, 0)
        for (_, i), g in zip(mine[1:], gaps):
            album += (n * g > s and (n * g - s) ** 2 > 4 * (n * q - s * s)) if auto else g > limit
            out[key, i] = (g, album)
    return out


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("n", [1, 7, 16, 64])
def test_ranged_albums_by_brute_force(spark, n, keyed):
    """Skewed times, many equal ones, a key with most rows, a null key; extra columns are kept."""
    r = random.Random(n)
    rows = []
    for i in range(3000):
        t = r.choice((0, 5_000, 5_000, r.randint(0, 10**6), int(10**6 * r.random() ** 8), 10**9 + r.randint(0, 99)))
        rows.append((r.choice((1, 1, 1, 1, 2, 3, None)) if keyed else 0, i, t))
    df = spark.createDataFrame([(k, i, T0 + dt.timedelta(milliseconds=t), f"v{i}", float(i)) for k, i, t in rows], "k int, id int, ts timestamp_ntz, note string, value double")
    df = with_t_ms(df.repartition(13, "note"))
    for auto in (True, False):
        p = Params(auto=auto, separation=2, unit="minutes")
        out = sessions.assign_ranged(df, ["k"] if keyed else [], "id", p, n)
        got = {(x["k"], x["id"]): (x["sep_ms"], x["album_id"]) for x in out.collect()}
        assert got == brute_albums(rows, auto, 120_000)
        assert {(x["id"], x["note"], x["value"]) for x in out.collect()} == {(i, f"v{i}", float(i)) for _, i, _ in rows}


def test_large_keys_take_the_ranged_form(spark):
    rows = with_t_ms(at(spark, [0, 1, 2, 900, 901, 5000]))
    small, large = (sorted(sessions.assign_any(rows, ["k"], "id", most=m).select("id", "sep_ms", "album_id").collect()) for m in (6, 5))
    assert small == large
    assert sessions.assign_any(rows.limit(0), ["k"], "id", most=0).count() == 0 == sessions.assign_ranged(rows.limit(0), [], "id").count()


def test_places_without_sorting_a_key_in_one_task(spark):
    rows = spark.range(1000).selectExpr("id", "case when id % 10 < 7 then 'big' when id % 10 < 9 then 'b' end as k", "id % 17 as o")
    a = {x["id"]: (x["_i"], x["_n"]) for x in with_index(rows, ["k"], ["o", "id"], 9).collect()}
    for key in ("big", "b", None):
        mine = sorted((i % 17, i) for i in range(1000) if ("big" if i % 10 < 7 else "b" if i % 10 < 9 else None) == key)
        assert [a[i] for _, i in mine] == [(at, len(mine)) for at in range(len(mine))]
    plain, ranged = (sorted(ordering.progressive_priority(rows, ["k"], ["o", "id"], r).select("id", "priority").collect()) for r in (False, True))
    assert plain == ranged


@pytest.mark.parametrize(
    ("seconds", "want"),
    [([], []), ([0], [1]), ([0, 99], [2]), ([0, 1, 2, 3, 4, 1000], [6]), ([0, 1, 2, 3, 4, 5, 1000], [6, 1]), ([5] * 8, [8])],
)
def test_automatic_edges(spark, seconds, want):
    assert sizes(spark, seconds) == want


def test_manual_edges(spark):
    p = Params(auto=False, separation=10_000, unit="seconds")
    assert sizes(spark, [0, 10, 20.001], p) == [2, 1]
    assert sizes(spark, [0, 10], Params(auto=False, separation=10, unit="seconds", unit_compat=False)) == [2]
    assert sizes(spark, [0, 0, 0], Params(auto=False, separation=-1, unit="minutes")) == [1, 1, 1]
    assert unit_ms("months") == 30 * unit_ms("days") and unit_ms("years") == 365 * unit_ms("days")


def test_order_does_not_matter_and_gaps_respect_the_threshold(spark):
    r = random.Random(3)
    seconds = [r.choice([1, 5, 900]) * i for i in range(60)]
    shuffled = at(spark, seconds).orderBy(F.rand(1))
    a = sessions.assign(with_t_ms(at(spark, seconds)), ["k"], "id").select("id", "album_id").collect()
    b = sessions.assign(with_t_ms(shuffled), ["k"], "id").select("id", "album_id").collect()
    assert sorted(a) == sorted(b)
    g = sessions.assign_global(with_t_ms(shuffled), "id", partitions=7).select("id", "album_id").collect()
    assert sorted(g) == sorted(a)


def test_undated_rows_are_set_aside(spark):
    rows = at(spark, [0, 1]).union(spark.sql("select 0, 9, cast(null as timestamp_ntz)"))
    assert undated(rows).count() == 1 and albums(rows, ["k"], "id").head()["n_photos"] == 2
    assert summary(rows, ["k"], "id", params=Params(unit="minutes")).head()["n_gaps"] == 1


def test_progressive_order():
    assert progressive_order(3) == [0, 2, 1]
    assert progressive_order(4) == [0, 3, 2, 1]
    assert progressive_order(7) == [0, 6, 3, 1, 2, 4, 5]
    assert progressive_order(10) == [0, 9, 5, 1, 4, 3, 2, 6, 8, 7]
    assert all(sorted(progressive_order(n)) == list(range(n)) for n in range(120))


def test_priority_by_descent(spark):
    rows = spark.createDataFrame([(i, n) for n in (*range(1, 60), 1000) for i in range(n)], "i long, n long")
    want = {(i, n): at for n in (*range(1, 60), 1000) for at, i in enumerate(progressive_order(n))}
    assert {(r["i"], r["n"]): r["p"] for r in rows.select("i", "n", ordering.priority_of(F.col("i"), F.col("n")).alias("p")).collect()} == want
    far = spark.range(1).select(ordering.priority_of(F.lit(10**9 - 1), F.lit(10**9)).alias("a"), ordering.priority_of(F.lit(10**9 // 2), F.lit(10**9)).alias("b")).head()
    assert (far["a"], far["b"]) == (1, 2)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


def test_resolution(spark):
    m = F.lit("2020-02-02 01:02:03").cast("timestamp_ntz")
    cases = [
        ("IMG_20150815_1.jpg", "2016:01:02 03:04:05", dt.datetime(2016, 1, 2, 3, 4, 5)),
        ("IMG_20150815_1.jpg", None, dt.datetime(2015, 8, 15)),
        ("2015-08/15x", None, dt.datetime(2015, 8, 15)),
        ("2015_08_15.jpg", None, dt.datetime(2020, 2, 2, 1, 2, 3)),
        ("IMG_12345678.jpg", None, dt.datetime(1238, 10, 17)),
        ("IMG_5472.jpg", "0000:00:00 00:00:00", dt.datetime(2020, 2, 2, 1, 2, 3)),
    ]
    for name, tag, want in cases:
        assert one(spark, resolve_timestamp(F.lit(tag).cast("string"), F.lit(name), m)) == want
    assert one(spark, filename_date(F.lit("x00990101"))) == dt.datetime(1999, 1, 1)
    assert one(spark, strftime(F.lit("2015-08-05").cast("timestamp_ntz"), "%Y_%m%b_%d%%")) == "2015_08Aug_05%"
    with pytest.raises(ValueError):
        strftime(F.col("x"), "%Q")
    assert one(spark, basename(F.lit("/a/b.jpg"))) == "b.jpg" and one(spark, dirname(F.lit("/a/b.jpg"))) == "/a"
    assert bytes(one(spark, data_uri_bytes(F.lit("data:image/png;base64,aGk=")))) == b"hi"


@pytest.mark.parametrize("order", ["<", ">"])
def test_jpeg_bytes(order):
    data = sample_jpeg(order, "2016:01:02 03:04:05", "sea")
    tags = X.decode_exif(data)
    assert tags["DateTime"] == "2016:01:02 03:04:05" and tags["Make"] == "Cam" and tags["XResolution"].parts == (72, 1)
    assert X.decode_iptc(data) == {"keywords": ["sea"]}
    assert X.decode_exif(data[:40]) == {} and X.decode_exif(b"") == {} and X.decode_exif(b"\xff\xd8") == {}
    assert X.decode_exif(data.replace(b"Exif", b"Http", 1)) == {}


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_types(order):
    def tiff(kind, n, payload, tag=0x0111, first=8, magic=42):
        slot = payload.ljust(4, b"\0") if len(payload) <= 4 else struct.pack(order + "I", 26)
        ifd = struct.pack(order + "H", 1) + struct.pack(order + "HHI", tag, kind, n) + slot + b"\0" * 4
        return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", magic, first) + ifd + payload

    p = lambda code, *v: struct.pack(order + code, *v)
    got = [X.decode_tiff(tiff(*a), 0).get("StripOffsets") for a in ((1, 1, b"\x07"), (1, 5, bytes(range(5))), (2, 6, b"hello\0"), (3, 1, p("H", 9)), (3, 3, p("HHH", 1, 2, 3)), (4, 1, p("I", 7)), (7, 2, b"\1\2"), (9, 1, p("i", -5)), (10, 1, p("ii", -1, 2)))]
    assert got == [7, [0, 1, 2, 3, 4], "hello", 9, [1, 2, 3], 7, [1, 2], -5, -0.5]
    assert all(X.decode_tiff(tiff(k, 1, b"\1"), 0) == {"StripOffsets": None} for k in (6, 8, 11, 12))
    assert X.decode_tiff(tiff(3, 1, p("H", 9), first=4), 0) == {} == X.decode_tiff(tiff(3, 1, p("H", 9), magic=43), 0)


def test_files_to_copies(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(8):
        (src / f"p{i}.JPG").write_bytes(sample_jpeg("<", f"2016:01:0{1 + (i == 7)} 00:0{i}:00", "k"))
    (src / "notes.txt").write_text("x")
    (src / "IMG_20150815.jpg").write_bytes(b"no image")
    assert files.scan_directory(spark, str(src)).count() == 8 and files.scan_tree(spark, str(tmp_path)).count() == 9
    kept = files.photos(files.scan(spark, str(src)), Params(include_all=False))
    assert kept.count() == 9 and kept.where("create_date = timestamp_ntz'2015-08-15 00:00:00'").count() == 1
    assert files.photos_with_exif(files.scan(spark, str(src))).count() == 8
    assert photo_albums(files.scan_directory(spark, str(src))).count() == 2
    heads = files.with_heads(files.scan_directory(spark, str(src)), 5).collect()
    assert len(heads) == 8 and all(len(r["content"]) == 5 for r in heads)
    listed = files.scan(spark, str(src), content=False)
    assert "content" not in listed.columns and files.photos(listed, Params(include_all=False)).exceptAll(kept).count() == 0
    gone = listed.withColumn("path", F.concat("path", F.lit(".none")))
    assert files.with_heads(gone, 5).where("content is null").count() == listed.count()
    assert bytes(files.find_image(files.scan(spark, str(src)), "IMG_20150815.jpg").head()["content"]) == b"no image"
    rows = files.scan_directory(spark, str(src)).select(F.regexp_replace("path", "^file:/+", "/").alias("url"), F.lit("A").alias("name"))
    plan = copying.manifest(rows, str(tmp_path / "out"))
    assert {r["status"] for r in copying.execute(plan).collect()} == {"planned"}
    done = copying.execute(plan, dry_run=False)
    assert copying.progress(done).head()["n_done"] == 8 and len(os.listdir(tmp_path / "out" / "A")) == 8
    shown = files.scan_directory(spark, str(src), content=True).select(X.metadata("content").alias("m")).select(X.pretty(F.col("m.exif")).alias("t")).head()["t"]
    assert "XResolution : 72 [72/1]\r\n" in shown


def test_text_sources(spark, tmp_path):
    with open(tmp_path / "s.csv", "w", newline="") as f:
        csv.writer(f).writerows([["date", "price"], ["Jan 2000", "1.5"], ["bad", "x"]])
    rows = files.read_series(spark, str(tmp_path / "s.csv")).collect()
    assert rows[0]["date"] == dt.date(2000, 1, 1) and rows[1]["date"] is None and rows[1]["price"] is None
    (tmp_path / "l.json").write_text('[{"file":"a","exif":{"CreateDate":"2016:01:02 03:04:05"}},{"file":"b","exif":{}}]')
    assert [r["file"] for r in files.read_listing(spark, str(tmp_path / "l.json")).collect()] == ["a"]


def test_moves_and_flattening(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.jpg").write_text(folder)
        (tmp_path / folder / f"{folder}.jpg").write_text(folder)
    listed = files.scan_tree(spark, str(tmp_path)).select(F.regexp_replace("path", "^file:/+", "/").alias("url"))
    urls = spark.createDataFrame(listed.collect(), listed.schema)
    assert copying.default_output(urls.withColumn("id", F.col("url"))).head()["output"] == f"{tmp_path}/a"
    plan = copying.flatten_manifest(urls, output=f"{tmp_path}/out")
    assert copying.flatten_manifest(urls).where("dest = 'same.jpg'").count() == 2
    plan = spark.createDataFrame(plan.collect(), plan.schema)
    done = copying.execute(plan, dry_run=False).collect()
    assert sorted(r["status"] for r in done) == ["conflict", "done", "done", "done"]
    assert sorted(os.listdir(tmp_path / "out")) == ["a.jpg", "b.jpg", "same.jpg"] and (tmp_path / "out" / "same.jpg").read_text() == "a"
    assert os.listdir(tmp_path / "a") == [] and os.listdir(tmp_path / "b") == ["same.jpg"]
    again = copying.execute(plan, dry_run=False).collect()  # as a retried task would
    assert sorted(r["status"] for r in again) == ["conflict", "done", "done", "done"]
    gone = copying.manifest(spark.createDataFrame([(f"{tmp_path}/none.jpg", "A")], "url string, name string"), f"{tmp_path}/out", move=True)
    assert copying.execute(gone, dry_run=False).head()["status"].startswith("failed")


def sub_directories(order):
    """A JPEG whose first directory leads to an EXIF and a GPS directory."""
    p = lambda code, *v: struct.pack(order + code, *v)

    def directory(entries):
        return p("H", len(entries)) + b"".join(p("HHI", tag, kind, n) + value.ljust(4, b"\0") for tag, kind, n, value in entries) + b"\0" * 4

    first, exif = 8, 8 + 2 + 12 * 2 + 4
    own = [(0x9000, 7, 4, b"0230"), (0xA000, 7, 4, b"0100"), (0x9101, 7, 4, b"\1\2\3\0"), (0x9207, 3, 1, p("H", 5)), (0x9209, 3, 1, p("H", 0x77)), (0xA002, 4, 1, p("I", 640))]
    gps = exif + 2 + 12 * len(own) + 4
    after = gps + 2 + 12 * 3 + 4
    body = directory([(0x8769, 4, 1, p("I", exif)), (0x8825, 4, 1, p("I", gps))]) + directory(own)
    body += directory([(0, 1, 4, b"\2\3\0\0"), (1, 2, 2, b"N\0"), (2, 5, 3, p("I", after))]) + p("IIIIII", 48, 1, 30, 1, 15, 2)
    tiff = (b"II" if order == "<" else b"MM") + p("HI", 42, first) + body
    app1 = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_sub_directories(spark, order):
    tags = X.decode_exif(sub_directories(order))
    assert (tags["ExifVersion"], tags["FlashpixVersion"], tags["GPSVersionID"], tags["GPSLatitudeRef"]) == ("0230", "0100", "2.3.0.0", "N")
    assert tags["MeteringMode"] == "Pattern" and tags["Flash"] is None and tags["PixelXDimension"] == 640
    assert tags["ComponentsConfiguration"] == "YCbCr" and [float(x) for x in tags["GPSLatitude"]] == [48, 30, 7.5]
    df = spark.createDataFrame([(bytearray(sub_directories(order)),), (None,)], "content binary").select(X.metadata("content").alias("m"))
    rows = [r["m"]["exif"] for r in df.collect()]
    assert rows[0]["ExifVersion"]["text"] == "0230" and "Flash" not in rows[0] and rows[0]["GPSLatitude"]["items"] == [48, 30, 7.5] and not rows[1]


def test_listing_as_json(spark, tmp_path):
    rows = spark.createDataFrame([("a.jpg", {"CreateDate": "2016:01:02 03:04:05"}), ("b.jpg", {})], "file string, exif map<string,string>")
    files.write_listing(rows, str(tmp_path / "l"))
    assert sorted(r["file"] for r in spark.read.json(str(tmp_path / "l")).collect()) == ["a.jpg", "b.jpg"]
    files.write_listing(rows.limit(0), str(tmp_path / "none"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "none")).count() == 0


def test_scales_and_thumbnails(spark):
    rows = with_t_ms(at(spark, [0, 50, 100]))
    web = [r["x"] for r in layout.points(rows, ["k"], layout.inner_width(web=True)).orderBy("id").collect()]
    detail = layout.series(rows, F.col("t_ms"), F.col("id"), ["k"], zoom=(0, 1)).count()
    assert web == [0, 480, 960] and detail == 3
    whole = [r["px"] for r in layout.series(rows, F.col("t_ms"), F.col("id")).orderBy("id").collect()]
    assert whole == [0, 330, 660]
    old = diff.with_position(rows, ["k"], ["t_ms"])
    assert {r["change"] for r in diff.keyed_diff(old, old.where("pos < 2"), ["k", "pos"]).collect()} == {"update", "exit"}


def photos_in(spark, folder, n, per_file=1):
    rows = with_t_ms(at(spark, [i * 10 + (i > n // 2) * 9000 for i in range(n)])).drop("t_ms")
    rows.coalesce(1).write.option("maxRecordsPerFile", per_file).parquet(folder)
    return rows


def test_stream_of_files_in_batches_of_fifty(spark, tmp_path):
    rows = photos_in(spark, str(tmp_path / "in"), 120)
    seen = []
    stream = recompute.file_stream(spark, str(tmp_path / "in"), rows.schema)

    def publish(df, number):
        seen.append((number, [r["n_photos"] for r in df.orderBy("album_id").collect()]))

    recompute.start_recompute(stream, ["k"], "id", "ts", str(tmp_path / "store"), str(tmp_path / "state"), publish).awaitTermination()
    assert [n for n, _ in seen] == [0, 1, 2] and seen[-1][1] == [61, 59]
    sizes = [spark.read.parquet(str(tmp_path / "store" / f"_batch={i}")).count() for i in range(3)]
    assert sizes == [50, 50, 20]


def test_batches_may_come_again_and_late(spark, tmp_path):
    """A batch that is delivered twice overwrites itself; a late row splits what was whole."""
    rows = at(spark, [0, 1, 2, 3, 4, 5, 7200, 7201])
    out = []
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    rows.where("id not in (6, 7)").coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: recompute.start_recompute(recompute.file_stream(spark, str(tmp_path / "in"), rows.schema, 1), ["k"], "id", "ts", store, state, lambda df, n: out.append((n, df.count())), Params(auto=False, separation=1, unit="hours")).awaitTermination()
    run()
    before = spark.read.parquet(store).count()
    import shutil

    shutil.rmtree(tmp_path / "state" / "commits")  # as if the query had died before the commit
    run()
    assert spark.read.parquet(store).count() == before == 6 and out[-1] == (0, 1)
    rows.where("id in (6, 7)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert out[-1] == (1, 2)


def test_fixed_gap_stream(spark, tmp_path):
    rows = photos_in(spark, str(tmp_path / "in"), 20, 10)
    far = spark.createDataFrame([(0, 99, dt.datetime(2015, 9, 1))], rows.schema)
    far.write.mode("append").parquet(str(tmp_path / "in"))
    stream = recompute.file_stream(spark, str(tmp_path / "in"), rows.schema)
    out = recompute.fixed_gap(stream, ["k"], "ts", 600_000, "1 hour")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["n_photos"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [9, 11]


def test_library_stands_when_the_optional_folders_are_gone(tmp_path):
    """A copy without the subpackage and its tests still imports and lists its own queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e, bench; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'albums_auto_by_user' in q; print(sum(n.startswith('op') or n == 'pipeline' for n in q))"
    for gone in ((), ("tidegap/llm", "tests/llm"), ("corpus_pipeline.py",)):
        for name in gone:
            path = copy / name
            shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
        if gone:
            out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
            assert out.returncode == 0 and out.stdout.strip() == "0", out.stderr


def test_library_stands_without_the_optional_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for base, _, names in os.walk(os.path.join(root, "tidegap")):
        if os.path.basename(base) != "llm":
            assert not any("tidegap.llm" in open(os.path.join(base, n)).read() for n in names if n.endswith(".py"))
