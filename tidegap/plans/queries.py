"""Queries over the driver's tables, each with the SQL that must agree with it."""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegap.functions import exif as X
from tidegap.functions.paths import basename, data_uri_bytes, dirname, is_media, mime_of, thumbnail_url
from tidegap.functions.timestamps import filename_date, parse_exif, resolve_timestamp
from tidegap.operators import copying, diff, layout, ordering
from tidegap.operators.gaps import gap_stats, gaps, with_t_ms
from tidegap.operators.naming import with_names
from tidegap.operators.sessions import assign, assign_global, assign_ranged, by_session_window, collect_photos, summarise
from tidegap.params import Params, from_unit, to_unit
from tidegap.storage import shared_dir

KEYS, ID = ["user_id"], "event_id"
HALF_DAY = Params(auto=False, separation=12, unit="hours")
LONG = Params(auto=False, separation=30, unit="hours")
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return with_t_ms(table(spark, d, "events").select("event_id", "user_id", "ts", *cols))


def album_rows(spark: SparkSession, d: str, params: Params = Params()) -> DataFrame:
    return summarise(assign(events(spark, d), KEYS, ID, params), KEYS, ID)


SHOWN = ["user_id", "album_id", "start", "end", "n_photos"]
T_ZERO = 1_704_067_200_000  # 2024-01-01 00:00:00


def gaps_by_user(s, d):
    return gaps(events(s, d), KEYS, ID).where("sep_ms is not null").select("user_id", "event_id", "sep_ms")


def gap_stats_by_user(s, d):
    cols = [F.round(c, 3).alias(c) for c in ("avg_ms", "stdev_ms", "threshold_ms")]
    return gap_stats(gaps(events(s, d), KEYS, ID), KEYS).select("user_id", "n_gaps", *cols)


def gap_stats_in_unit(s, d):
    stats = gap_stats(gaps(events(s, d), KEYS, ID), KEYS)
    names = [("avg_ms", "avg_hours"), ("stdev_ms", "stdev_hours"), ("threshold_ms", "separation_hours")]
    return stats.select("user_id", *[F.round(to_unit(F.col(a), "hours"), 6).alias(b) for a, b in names])


def albums_auto_by_user(s, d):
    return album_rows(s, d).select(SHOWN)


def album_members_auto(s, d):
    return assign(events(s, d), KEYS, ID).select("user_id", "event_id", "album_id")


def albums_auto_global(s, d):
    return summarise(assign_global(events(s, d), ID), [], ID).select(SHOWN[1:])


def album_members_global(s, d):
    """All columns are kept beside the album of the one timeline."""
    out = assign_global(events(s, d, "event_type", "value"), ID)
    return out.select("event_id", "user_id", "event_type", "value", "sep_ms", "album_id")


def album_members_ranged(s, d):
    """Keyed albums in the form for large keys."""
    return assign_ranged(events(s, d, "value"), KEYS, ID).select("user_id", "event_id", "value", "album_id")


def albums_manual_by_user(s, d):
    return album_rows(s, d, HALF_DAY).select(SHOWN)


def albums_manual_global(s, d):
    return summarise(assign_global(events(s, d), ID, Params(auto=False, separation=30, unit="minutes")), [], ID).select(SHOWN[1:])


def albums_session_window(s, d):
    return by_session_window(table(s, d, "events").select("user_id", "ts"), KEYS, "ts", 43_200_000)


def albums_named(s, d):
    return with_names(album_rows(s, d)).select("user_id", "album_id", "name")


def album_representatives(s, d):
    out = album_rows(s, d)
    urls = [thumbnail_url(F.col(c).cast("string"), F.lit(True)).alias(f"{c}_url") for c in ("first_photo", "last_photo")]
    return out.select("user_id", "album_id", "first_photo", "last_photo", *urls)


def timeline_extent(s, d):
    return layout.extent(events(s, d), KEYS)


def timeline_points(s, d):
    return layout.points(events(s, d), KEYS).select("user_id", "event_id", F.round("x", 6).alias("x"), "y", "r")


def timeline_regions(s, d):
    out = layout.regions(album_rows(s, d), KEYS)
    return out.select("user_id", "album_id", F.round("x", 6).alias("x"), F.round("width", 6).alias("width"), "height")


def timeline_brush(s, d):
    """Detail scale of a series: twelve days fill the width, no row is dropped."""
    rows = events(s, d, "value")
    half = F.lit(12).cast("double")
    lo = F.lit(T_ZERO).cast("double")
    out = layout.series(rows, F.col("t_ms"), F.col("value"), KEYS, zoom=(lo, lo + from_unit(half, "days")))
    return out.select("user_id", "event_id", F.round("px", 8).alias("px"))


def timeline_web(s, d):
    """Points on the wider scale of the web form."""
    out = layout.points(events(s, d), KEYS, layout.inner_width(web=True))
    return out.select("user_id", "event_id", F.round("x", 6).alias("x"))


def region_colors(s, d):
    return layout.colors(with_names(album_rows(s, d)), KEYS).select("user_id", "album_id", "color")


def series_layout(s, d):
    out = layout.series(events(s, d, "value"), F.col("t_ms"), F.col("value"), KEYS)
    return out.select("user_id", "event_id", F.round("px", 5).alias("px"), F.round("py", 5).alias("py"))


def progress_arc(s, d):
    out = table(s, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count("*").alias("total"))
    return out.select("o_custkey", F.round(layout.progress_arc(F.col("done"), F.col("total")), 6).alias("angle"))


def file_names(s, d):
    """Synthetic file names out of orders."""
    ext = F.element_at(F.array(*map(F.lit, ("jpg", "mov", "txt", "PNG", "pdf"))), (F.pmod("o_orderkey", F.lit(5)) + 1).cast("int"))
    name = F.concat(F.lit("IMG_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit("."), ext)
    return table(s, d, "orders").select("o_orderkey", "o_orderdate", "o_custkey", name.alias("name"))


NAMES_SQL = """select o_orderkey, o_orderdate, o_custkey, 'IMG_' || strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey || '.' ||
  (['jpg','mov','txt','PNG','pdf'])[(o_orderkey % 5 + 1)::int] as name from orders"""


def mime_filter(s, d):
    out = file_names(s, d).withColumn("mime", mime_of(F.col("name")))
    return out.where(is_media(F.col("mime"))).select("o_orderkey", "name", "mime")


def filename_dates(s, d):
    return file_names(s, d).select("o_orderkey", filename_date(F.col("name")).alias("taken"))


def filename_date_rollover(s, d):
    n = F.col("o_orderkey")
    digits = F.concat(F.lpad((1950 + F.pmod(n, F.lit(90))).cast("string"), 4, "0"), F.lpad(F.pmod(n, F.lit(100)).cast("string"), 2, "0"), F.lpad(F.pmod(n * 7, F.lit(100)).cast("string"), 2, "0"))
    return table(s, d, "orders").select("o_orderkey", filename_date(F.concat(F.lit("x"), digits)).alias("taken"))


def exif_datetime_parse(s, d):
    text = F.when(F.col("event_id") % 10 == 0, F.lit("0000:00:00 00:00:00")).otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    return table(s, d, "events").select("event_id", parse_exif(text).alias("taken"))


def resolved_timestamp(s, d):
    n = F.col("o_orderkey")
    exif = F.when(n % 3 == 0, F.date_format(F.col("o_orderdate") + F.expr("interval 1 hour"), "yyyy:MM:dd HH:mm:ss"))
    name = F.when(n % 2 == 0, F.col("name")).otherwise(F.lit("IMG_5472.jpg"))
    mtime = F.col("o_orderdate") + F.expr("interval 2 days")
    return file_names(s, d).select("o_orderkey", resolve_timestamp(exif, name, mtime).alias("taken"))


def path_parts(s, d):
    return table(s, d, "pages").select("page_id", basename(F.col("url")).alias("base"), dirname(F.col("url")).alias("dir"))


def enum_decode(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", X.label("MeteringMode", F.col("l_linenumber")).alias("label"))


def base64_roundtrip(s, d):
    uri = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8")))
    back = F.decode(data_uri_bytes(uri), "UTF-8")
    return table(s, d, "documents").select("doc_id", F.md5(back.cast("binary")).alias("digest"), (back == F.col("text")).alias("same"))


def batch_chunks(s, d):
    return ordering.chunks(events(s, d), KEYS, ["t_ms", ID]).groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("low"))


def batch_chunks_ranged(s, d):
    """Batches in the form for large keys."""
    return ordering.chunks(events(s, d, "value"), KEYS, ["t_ms", ID], ranged=True).groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("low"))


def progressive_order(s, d):
    return ordering.progressive_priority(events(s, d), KEYS, ["t_ms", ID]).select("user_id", "event_id", "priority")


def keyed_diff(s, d):
    """Albums by user and first photo: the automatic against the 30-hour albums."""
    return diff.keyed_diff(album_rows(s, d), album_rows(s, d, LONG), ["user_id", "first_photo"])


def indexed_diff(s, d):
    """Albums by user and place: the automatic against the 30-hour albums."""
    auto, long = (diff.with_position(album_rows(s, d, p), KEYS, ["start_ms"]) for p in (Params(), LONG))
    return diff.keyed_diff(auto, long, ["user_id", "pos"])


def copy_manifest(s, d):
    rows = assign(events(s, d), KEYS, ID)
    names = with_names(summarise(rows, KEYS, ID)).select("user_id", "album_id", "name")
    url = F.concat(F.lit("/in/"), F.col("user_id").cast("string"), F.lit("/"), F.pmod("event_id", F.lit(40)).cast("string"), F.lit(".jpg"))
    photos = rows.join(names, ["user_id", "album_id"]).withColumn("url", url)
    plan = copying.manifest(photos, "/out", "url", "name")
    return plan.groupBy("dest", "action").agg(F.count("*").alias("n"), F.count_if("conflict").alias("n_conflicts"), F.min("source").alias("source"))


def sample_jpeg(order: str, date: str, keyword: str) -> bytes:
    """A minimal JPEG with one EXIF date, one rational and one IPTC keyword."""
    c = {"<": b"II", ">": b"MM"}[order]
    text = date.encode() + b"\0"
    body = struct.pack(order + "HHHI", 42, 0, 0, 0)[:2]
    entries = [(0x010F, 2, 4, b"Cam\0"), (0x0132, 2, len(text), None), (0x011A, 5, 1, None)]
    after, ifd = 8 + 2 + 12 * len(entries) + 4, struct.pack(order + "H", len(entries))
    blob = b""
    for (tag, kind, n, inline), data in zip(entries, (b"", text, struct.pack(order + "II", 72, 1)), strict=True):
        slot = inline or struct.pack(order + "I", after + len(blob))
        ifd += struct.pack(order + "HHI", tag, kind, n) + slot
        blob += data
    tiff = c + body + struct.pack(order + "I", 8) + ifd + b"\0" * 4 + blob
    app1 = b"Exif\0\0" + tiff
    word = keyword.encode("latin-1")
    record = b"\x1c\x02\x19" + struct.pack(">h", len(word)) + word
    app13 = b"Photoshop 3.0\0" + b"8BIM\x04\x04\0\0\0\0" + struct.pack(">H", len(record)) + record
    return b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xed" + struct.pack(">H", len(app13) + 2) + app13 + b"\xff\xd9"


def _jpegs(s, d):
    """Every event as a JPEG made of two templates of fixed layout, patched in the JVM."""
    mark = "0000:00:00 00:00:00"
    parts = [[F.unbase64(F.lit(base64.b64encode(p).decode())) for p in sample_jpeg(o, mark, "key").split(mark.encode())] for o in "<>"]
    date = F.encode(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), "UTF-8")
    body = [F.concat(a, date, b) for a, b in parts]
    return table(s, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, body[0]).otherwise(body[1]).alias("content"))


def exif_decode(s, d):
    e = F.col("m.exif")
    out = _jpegs(s, d).select("event_id", X.metadata("content").alias("m"))
    return out.select("event_id", parse_exif(X.get_tag(e, "DateTime")).alias("taken"), X.get_tag(e, "Make").alias("make"), X.get_tag(e, "XResolution").alias("x_resolution"))


def iptc_decode(s, d):
    out = _jpegs(s, d).select("event_id", X.metadata("content").alias("m"))
    return out.select("event_id", F.try_element_at("m.iptc", F.lit("keywords"))[0].alias("keyword"))


def album_photos_json(s, d):
    """Each album with its photos nested in time order, as JSON."""
    out = collect_photos(assign(events(s, d), KEYS, ID), KEYS, ID)
    row = F.struct("user_id", "album_id", F.transform("photos", lambda p: F.struct(p["t_ms"].alias("t_ms"), p["id"].alias("id"))).alias("photos"))
    return out.select("user_id", "album_id", F.to_json(row).alias("json"))


def album_thumbnails_diff(s, d):
    """Thumbnails by place in an album: the automatic against the half-day albums."""
    auto, half = (diff.with_position(assign(events(s, d), KEYS, ID, p), ["user_id", "album_id"], ["t_ms", ID]) for p in (Params(), HALF_DAY))
    return diff.keyed_diff(auto, half, ["user_id", "album_id", "pos"])


def thumbnail_urls(s, d):
    """Both forms of a thumbnail's URL; off the web it is hidden for two of three pages."""
    url = F.col("url")
    return table(s, d, "pages").select("page_id", thumbnail_url(url, F.col("page_id") % 3 == 0).alias("local"), thumbnail_url(url, F.lit(True), web=True).alias("web"))


def move_manifest(s, d):
    """A move into one album's directory below the directory of the first file."""
    url = F.concat(F.lit("/in/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("name"))
    files = file_names(s, d).select(F.col("o_orderkey").alias("id"), url.alias("url"), F.lit("A").alias("album"))
    where = copying.default_output(files).head()["output"]
    return copying.manifest(files, where, album="album", move=True).groupBy("dest", "action").agg(F.count("*").alias("n"), F.count_if("conflict").alias("n_conflicts"))


def flatten_moves(s, d):
    """Every file of a tree into one directory; of equal names all but one are conflicts."""
    url = F.concat(F.lit("/in/"), F.col("user_id").cast("string"), F.lit("/"), F.pmod("event_id", F.lit(97)).cast("string"), F.lit(".jpg"))
    plan = copying.flatten_manifest(table(s, d, "events").select(url.alias("url")), output="/flat")
    return plan.groupBy("dest", "action").agg(F.count("*").alias("n"), F.count_if("conflict").alias("n_conflicts"))


def images_only(s, d):
    out = file_names(s, d).withColumn("mime", mime_of(F.col("name")))
    return out.where(is_media(F.col("mime"), videos=False)).select("o_orderkey", "mime")


def summary_row(s, d):
    stats = gap_stats(gaps(events(s, d), KEYS, ID), KEYS)
    return stats.agg(F.sum("n_gaps").alias("n_gaps"), F.count("*").alias("n_timelines"), F.round(F.max("threshold_ms"), 3).alias("largest_threshold"))


def photos_json(s, d):
    row = F.struct(F.col("user_id"), F.col("album_id"), F.col("n_photos"))
    return album_rows(s, d).select("user_id", "album_id", F.to_json(row).alias("json"))


def stream_recompute(s, d):
    """Events fed as a stream; the last micro-batch's albums."""
    import uuid

    from tidegap.streaming.recompute import start_recompute

    home = f"{shared_dir(s)}/tidegap/stream-{uuid.uuid4().hex}"
    rows = table(s, d, "events").select("event_id", "user_id", "ts")
    rows.repartition(4, "event_id").write.parquet(f"{home}/in")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    query = start_recompute(stream, KEYS, ID, "ts", f"{home}/store", f"{home}/state", lambda df, n: df.write.mode("overwrite").parquet(f"{home}/out"))
    query.awaitTermination()
    return s.read.parquet(f"{home}/out").select(SHOWN)


# SQL: the places of the recursive order: an interval gives its ends and its middle, then its halves follow.
PROGRESSIVE = """with recursive s as (select user_id, event_id, row_number() over (partition by user_id order by (epoch_us(ts)//1000), event_id) - 1 as i, count(*) over (partition by user_id) as n from events where ts is not null),
t(user_id, lo, hi, base) as (select distinct user_id, 0::bigint, n, 0::bigint from s union all
  select user_id, unnest([lo + 1, lo + (hi - lo) // 2 + 1]), unnest([lo + (hi - lo) // 2, hi - 1]), unnest([base + 3, base + (hi - lo) // 2 + 2]) from t where hi - lo >= 3),
r as (select user_id, unnest(case when hi - lo >= 3 then [lo, hi - 1, lo + (hi - lo) // 2] else range(lo, hi) end) as i, unnest(case when hi - lo >= 3 then [base, base + 1, base + 2] else range(base, base + hi - lo) end) as p from t where hi > lo)
select user_id, event_id, p::int as priority from s join r using (user_id, i)"""

# SQL: gaps, exact automatic splits and albums as common table expressions.
GAPS = "g as (select user_id, event_id, (epoch_us(ts)//1000) as t, (epoch_us(ts)//1000) - lag((epoch_us(ts)//1000)) over w as x from events where ts is not null window w as (partition by user_id order by (epoch_us(ts)//1000), event_id))"
AUTO = """f as (select *, count(x) over p as n, sum(x::hugeint) over p as s, sum(x::hugeint * x::hugeint) over p as q from g window p as (partition by user_id)),
a as (select *, sum(case when n*x - s > 0 and (n*x - s)*(n*x - s) > 4*(n*q - s*s) then 1 else 0 end) over (partition by user_id order by t, event_id rows unbounded preceding)::int as album_id from f)"""
MANUAL = "a as (select *, sum(case when x > 43200000 then 1 else 0 end) over (partition by user_id order by t, event_id rows unbounded preceding)::int as album_id from g)"
ALBUMS = "b as (select user_id, album_id, min(t) as lo, max(t) as hi, count(*) as n_photos, arg_min(event_id, (t, event_id)) as first_photo, arg_max(event_id, (t, event_id)) as last_photo from a group by all)"
SHOW = "select user_id, album_id, make_timestamp(lo*1000) as start, make_timestamp(hi*1000) as \"end\", n_photos from b"
BY_USER = f"with {GAPS}, {AUTO}, {ALBUMS}"
POS = "(row_number() over (partition by user_id order by lo) - 1)::int as pos"
LONG_GAPS = MANUAL.replace("a as", "c as", 1).replace("43200000", "108000000")
LONG_ALBUMS = ALBUMS.replace("b as", "d as", 1).replace("from a", "from c")
BOTH = f"with {GAPS}, {AUTO}, {LONG_GAPS}, {ALBUMS}, {LONG_ALBUMS}, x as (select *, 1 as in_b, {POS} from b), y as (select *, 1 as in_d, {POS} from d)"
CHANGE = "case when in_d is null then 'exit' when in_b is null then 'enter' else 'update' end"
NAME = "strftime(make_timestamp(lo*1000), '%Y_%m%b_%d') || '_Album_' || (album_id + 1)"
ONE = [x.replace("partition by user_id ", "").replace("partition by user_id", "").replace("select user_id, album_id", "select album_id").replace("user_id, ", "") for x in (GAPS, AUTO, MANUAL, ALBUMS, SHOW)]
STATS = "avg(x) as m, stddev_pop(x) as sd, count(x) as n from g group by user_id"
STAMP = "strftime({}, '%Y:%m:%d %H:%M:%S')"

ORACLE: dict[str, str] = {
    "gaps_by_user": f"with {GAPS} select user_id, event_id, x as sep_ms from g where x is not null",
    "gap_stats_by_user": f"with {GAPS} select user_id, n as n_gaps, round(m, 3) as avg_ms, round(sd, 3) as stdev_ms, round(m + 2*sd, 3) as threshold_ms from (select user_id, {STATS})",
    "gap_stats_in_unit": f"with {GAPS} select user_id, round(m/3.6e6, 6) as avg_hours, round(sd/3.6e6, 6) as stdev_hours, round((m + 2*sd)/3.6e6, 6) as separation_hours from (select user_id, {STATS})",
    "albums_auto_by_user": f"{BY_USER} {SHOW}",
    "album_members_auto": f"with {GAPS}, {AUTO} select user_id, event_id, album_id from a",
    "albums_auto_global": f"with {ONE[0]}, {ONE[1]}, {ONE[3]} {ONE[4]}",
    "album_members_global": f"with {ONE[0]}, {ONE[1]} select a.event_id, user_id, event_type, value, x as sep_ms, album_id from a join events using (event_id)",
    "album_members_ranged": f"with {GAPS}, {AUTO} select a.user_id, a.event_id, value, album_id from a join events using (event_id)",
    "albums_manual_by_user": f"with {GAPS}, {MANUAL}, {ALBUMS} {SHOW}",
    "albums_manual_global": f"with {ONE[0]}, {ONE[2]}, {ONE[3]} {ONE[4]}".replace("43200000", "1800000"),
    "albums_session_window": f"with {GAPS}, {MANUAL}, {ALBUMS} {SHOW}".replace("album_id, make", "make"),
    "albums_named": f"{BY_USER} select user_id, album_id, {NAME} as name from b",
    "album_representatives": f"{BY_USER} select user_id, album_id, first_photo, last_photo, 'file://' || first_photo as first_photo_url, 'file://' || last_photo as last_photo_url from b",
    "timeline_extent": "select user_id, min((epoch_us(ts)//1000)) as lo, max((epoch_us(ts)//1000)) as hi from events where ts is not null group by user_id",
    "timeline_points": "with e as (select user_id, event_id, (epoch_us(ts)//1000) as t, min((epoch_us(ts)//1000)) over p as lo, max((epoch_us(ts)//1000)) over p as hi from events where ts is not null window p as (partition by user_id)) select user_id, event_id, round(coalesce((t-lo)::double / nullif(hi-lo, 0)::double * 660.0, 0), 6) as x, 10 as y, 2 as r from e",
    "timeline_web": "with e as (select user_id, event_id, (epoch_us(ts)//1000) as t, min((epoch_us(ts)//1000)) over p as lo, max((epoch_us(ts)//1000)) over p as hi from events where ts is not null window p as (partition by user_id)) select user_id, event_id, round(coalesce((t-lo)::double / nullif(hi-lo, 0)::double * 960.0, 0), 6) as x from e",
    "timeline_brush": f"select user_id, event_id, round(((epoch_us(ts)//1000) - {T_ZERO})::double / (12 * 86400000.0)::double * 660.0::double, 8) as px from events where ts is not null",
    "timeline_regions": f"{BY_USER}, c as (select *, min(lo) over p as l, max(hi) over p as h from b window p as (partition by user_id)), e as (select user_id, album_id, coalesce((lo-l)::double / nullif(h-l, 0)::double * 660.0, 0) as x, coalesce((hi-l)::double / nullif(h-l, 0)::double * 660.0, 0) as x2 from c) select user_id, album_id, round(x, 6) as x, round(x2 - x, 6) as width, 40 as height from e",
    "region_colors": f"{BY_USER}, c as (select user_id, album_id, min(lo) over (partition by user_id, {NAME}) as l, min(album_id) over (partition by user_id, {NAME}) as i from b) select user_id, album_id, (dense_rank() over (partition by user_id order by l, i) - 1) % 20 as color from c",
    "series_layout": "with e as (select user_id, event_id, value, (epoch_us(ts)//1000) as t, min((epoch_us(ts)//1000)) over p as lo, max((epoch_us(ts)//1000)) over p as hi, max(value) over p as top from events where ts is not null window p as (partition by user_id)) select user_id, event_id, round(coalesce((t-lo)::double / nullif(hi-lo, 0)::double * 660.0, 0), 5) as px, round(40.0::double * (1 - coalesce(value / nullif(top, 0), 0)), 5) as py from e",
    "progress_arc": "select o_custkey, round(2*pi() * (count(*) filter (o_orderstatus = 'F'))::double / count(*), 6) as angle from orders group by o_custkey",
    "mime_filter": f"select * from (select o_orderkey, name, case o_orderkey % 5 when 0 then 'image/jpeg' when 1 then 'video/quicktime' when 3 then 'image/png' end as mime from ({NAMES_SQL})) where mime is not null",
    "filename_date": "select o_orderkey, date_trunc('day', o_orderdate)::timestamp as taken from orders",
    "filename_date_rollover": "select o_orderkey, (make_date((1950 + o_orderkey % 90)::int, 1, 1) + to_months((o_orderkey % 100 - 1)::int) + to_days((o_orderkey * 7 % 100 - 1)::int))::timestamp as taken from orders",
    "exif_datetime_parse": "select event_id, case when event_id % 10 <> 0 then date_trunc('second', ts) end as taken from events",
    "resolved_timestamp": "select o_orderkey, case when o_orderkey % 3 = 0 then date_trunc('second', o_orderdate + interval 1 hour) when o_orderkey % 2 = 0 then date_trunc('day', o_orderdate)::timestamp else o_orderdate + interval 2 day end as taken from orders",
    "path_parts": "select page_id, split_part(url, '/', -1) as base, regexp_replace(url, '/[^/]*$', '') as dir from pages",
    "enum_decode": "select l_orderkey, l_linenumber, case l_linenumber when 0 then 'Unknown' when 1 then 'Average' when 2 then 'CenterWeightedAverage' when 3 then 'Spot' when 4 then 'MultiSpot' when 5 then 'Pattern' when 6 then 'Partial' when 255 then 'Other' end as label from lineitem",
    "base64_roundtrip": "select doc_id, md5(text) as digest, case when text is not null then true end as same from documents",
    "batch_chunks": "select user_id, batch, count(*) as n, min(event_id) as low from (select user_id, event_id, (row_number() over (partition by user_id order by (epoch_us(ts)//1000), event_id) - 1) // 50 as batch from events where ts is not null) group by all",
    "batch_chunks_ranged": "select user_id, batch, count(*) as n, min(event_id) as low from (select user_id, event_id, (row_number() over (partition by user_id order by (epoch_us(ts)//1000), event_id) - 1) // 50 as batch from events where ts is not null) group by all",
    "progressive_order": PROGRESSIVE,
    "album_thumbnails_diff": f"with {GAPS}, {AUTO}, pa as (select user_id, album_id, (row_number() over (partition by user_id, album_id order by t, event_id) - 1)::int as pos from a), {MANUAL.replace('a as', 'h as', 1)}, ph as (select user_id, album_id, (row_number() over (partition by user_id, album_id order by t, event_id) - 1)::int as pos from h) select user_id, album_id, pos, case when pa.user_id is null then 'enter' when ph.user_id is null then 'exit' else 'update' end as change from (select *, 1 as k from pa) pa full join (select *, 1 as k from ph) ph using (user_id, album_id, pos)".replace("pa.user_id is null", "pa.k is null").replace("ph.user_id is null", "ph.k is null"),
    "thumbnail_urls": "select page_id, case when page_id % 3 = 0 then 'file://' || url else '' end as local, 'images/' || split_part(url, '/', -1) as web from pages",
    "move_manifest": f"with f as (select '/in/' || arg_min(o_custkey, o_orderkey) as output from ({NAMES_SQL})) select output || '/A/' || name as dest, 'move' as action, count(*) as n, count(*) - 1 as n_conflicts from ({NAMES_SQL}), f group by dest",
    "flatten_moves": "select '/flat/' || (event_id % 97) || '.jpg' as dest, 'move' as action, count(*) as n, count(*) - 1 as n_conflicts from events group by dest",
    "images_only": f"select * from (select o_orderkey, case o_orderkey % 5 when 0 then 'image/jpeg' when 3 then 'image/png' end as mime from ({NAMES_SQL})) where mime is not null",
    "album_photos_json": f"with {GAPS}, {AUTO} select user_id, album_id, '{{\"user_id\":' || user_id || ',\"album_id\":' || album_id || ',\"photos\":[' || string_agg('{{\"t_ms\":' || t || ',\"id\":' || event_id || '}}', ',' order by t, event_id) || ']}}' as json from a group by user_id, album_id",
    "keyed_diff": f"{BOTH} select user_id, first_photo, {CHANGE} as change from x full join y using (user_id, first_photo)",
    "indexed_diff": f"{BOTH} select user_id, pos, {CHANGE} as change from x full join y using (user_id, pos)",
    "copy_manifest": f"{BY_USER}, m as (select '/in/' || a.user_id || '/' || (event_id % 40) || '.jpg' as source, '/out/' || {NAME} || '/' || (event_id % 40) || '.jpg' as dest from a join b using (user_id, album_id)) select dest, 'copy' as action, count(*) as n, count(*) - 1 as n_conflicts, min(source) as source from m group by dest",
    "exif_decode": "select event_id, date_trunc('second', ts) as taken, 'Cam' as make, '72' as x_resolution from events",
    "iptc_decode": "select event_id, 'key' as keyword from events",
    "summary_row": f"with {GAPS} select sum(n)::bigint as n_gaps, count(*) as n_timelines, round(max(m + 2*sd), 3) as largest_threshold from (select {STATS})",
    "photos_json": f"{BY_USER} select user_id, album_id, '{{\"user_id\":' || user_id || ',\"album_id\":' || album_id || ',\"n_photos\":' || n_photos || '}}' as json from b",
    "stream_recompute": f"{BY_USER} {SHOW}",
}

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        gaps_by_user, gap_stats_by_user, gap_stats_in_unit, albums_auto_by_user, album_members_auto, albums_auto_global,
        album_members_global, album_members_ranged, albums_manual_by_user, albums_manual_global, albums_session_window, albums_named, album_representatives,
        timeline_extent, timeline_points, timeline_web, timeline_brush, timeline_regions, region_colors, series_layout, progress_arc, mime_filter,
        filename_date_rollover, exif_datetime_parse, resolved_timestamp, path_parts, enum_decode, base64_roundtrip,
        batch_chunks, batch_chunks_ranged, progressive_order, album_thumbnails_diff, thumbnail_urls, move_manifest,
        flatten_moves, images_only, album_photos_json, keyed_diff, indexed_diff, copy_manifest, exif_decode, iptc_decode, summary_row,
        photos_json, stream_recompute,
    )
} | {"filename_date": filename_dates}
