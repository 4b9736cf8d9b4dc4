"""Path, MIME and data-URI expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# MIME type by lower-case file extension.
MIME = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "webp": "image/webp",
    "bmp": "image/bmp",
    "heic": "image/heic",
    "mp4": "video/mp4",
    "mov": "video/quicktime",
    "avi": "video/x-msvideo",
    "mpg": "video/mpeg",
    "mpeg": "video/mpeg",
    "webm": "video/webm",
    "mkv": "video/x-matroska",
}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def mime_of(name: Column) -> Column:
    """MIME type by extension, or the empty string."""
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))), F.lit(""))


def is_media(mime: Column, include_all: bool = False, videos: bool = True) -> Column:
    """The file filter: everything, or images (and videos) only."""
    return F.lit(include_all) | mime.rlike("image.*|video.*" if videos else "image.*")


def data_uri_bytes(uri: Column) -> Column:
    """Bytes of a ``data:...;base64,`` URI."""
    return F.unbase64(F.regexp_replace(uri, r"^data:[^,]*;base64,", ""))


def thumbnail_url(url: Column, visible: Column, web: bool = False) -> Column:
    """URL of a thumbnail; off the web only the first and last photo of an album have one."""
    if web:
        return F.concat(F.lit("images/"), basename(url))
    return F.when(visible, F.concat(F.lit("file://"), url)).otherwise(F.lit(""))
