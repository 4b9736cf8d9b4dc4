"""Embedded image metadata as Spark columns.

Binary headers are walked in an Arrow function; everything after that (lookups,
labels, printing) is built-in expressions over maps. A value is a struct of its
text and, for numbers, its parts, so that one map holds every tag type.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegap.functions.exif_tags import COMPONENTS, EXIF, GPS, IPTC, LABELS, TIFF

VALUE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("number", T.DoubleType()),
    T.StructField("numerator", T.LongType()),
    T.StructField("denominator", T.LongType()),
    T.StructField("items", T.ArrayType(T.DoubleType())),
])
SCHEMA = T.StructType([
    T.StructField("exif", T.MapType(T.StringType(), VALUE)),
    T.StructField("iptc", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])

# Width and struct code of the TIFF types that are decoded.
WIDTHS = {1: (1, "B"), 3: (2, "H"), 4: (4, "I"), 5: (8, "I"), 7: (1, "B"), 9: (4, "i"), 10: (8, "i")}


class Rational(float):
    """A quotient that remembers its parts."""

    def __new__(cls, a: int, b: int):
        self = super().__new__(cls, a / b if b else float("nan"))
        self.parts = (a, b)
        return self


class _Directory:
    """Reads the entries of one image file directory."""

    def __init__(self, data: bytes, base: int, order: str):
        self.data, self.base, self.order = data, base, order

    def _unpack(self, code: str, at: int) -> tuple:
        return struct.unpack_from(self.order + code, self.data, at)

    def read(self, offset: int, names: dict[int, str]) -> dict[str, object]:
        start = self.base + offset
        (count,) = self._unpack("H", start)
        found: dict[str, object] = {}
        for entry in range(start + 2, start + 2 + 12 * count, 12):
            tag, kind, n = self._unpack("HHI", entry)
            if tag in names:
                found[names[tag]] = self._value(kind, n, entry + 8)
        return found

    def _value(self, kind: int, n: int, slot: int) -> object:
        if kind == 2:
            at = self.base + self._unpack("I", slot)[0] if n > 4 else slot
            return self.data[at : at + max(n - 1, 0)].decode("latin-1")
        if kind not in WIDTHS:
            return None
        width, code = WIDTHS[kind]
        if n * width > len(self.data):
            raise ValueError("count beyond the data")
        at = self.base + self._unpack("I", slot)[0] if n * width > 4 else slot
        flat = self._unpack(f"{n * (2 if width == 8 else 1)}{code}", at)
        if kind == 5:
            flat = tuple(Rational(a, b) for a, b in zip(flat[::2], flat[1::2], strict=True))
        elif kind == 10:
            flat = tuple(a / b if b else float("nan") for a, b in zip(flat[::2], flat[1::2], strict=True))
        return flat[0] if n == 1 else list(flat)


def decode_tiff(data: bytes, base: int) -> dict[str, object]:
    """Tags of the directories that a TIFF header at ``base`` leads to; later ones win."""
    order = {b"II": "<", b"MM": ">"}.get(data[base : base + 2])
    if not order or struct.unpack_from(order + "H", data, base + 2)[0] != 42:
        return {}
    (first,) = struct.unpack_from(order + "I", data, base + 4)
    if first < 8:
        return {}
    directory = _Directory(data, base, order)
    tags = directory.read(first, TIFF)
    if at := tags.get("ExifIFDPointer"):
        tags |= {k: _labelled(k, v) for k, v in directory.read(at, EXIF).items()}
    if at := tags.get("GPSInfoIFDPointer"):
        gps = directory.read(at, GPS)
        if isinstance(v := gps.get("GPSVersionID"), list):
            gps["GPSVersionID"] = ".".join(map(str, v[:4]))
        tags |= gps
    return tags


def _labelled(tag: str, value: object) -> object:
    if tag in LABELS:
        return LABELS[tag].get(value) if isinstance(value, int) else None
    if tag in ("ExifVersion", "FlashpixVersion") and isinstance(value, list):
        return "".join(map(chr, value[:4]))
    if tag == "ComponentsConfiguration" and isinstance(value, list):
        return "".join(COMPONENTS.get(v, "") for v in value[:4])
    return value


def decode_exif(data: bytes) -> dict[str, object]:
    """Tags of a JPEG; only its first APP1 segment counts. Broken input has none."""
    try:
        at = 2 if data[:2] == b"\xff\xd8" else len(data)
        while at + 4 <= len(data) and data[at] == 0xFF:
            if data[at + 1] == 0xE1:
                return decode_tiff(data, at + 10) if data[at + 4 : at + 8] == b"Exif" else {}
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    except (struct.error, ValueError, IndexError):
        pass
    return {}


def decode_iptc(data: bytes) -> dict[str, list[str]]:
    """IPTC fields of a JPEG's first image resource block; always lists."""
    out: dict[str, list[str]] = {}
    at = data.find(b"8BIM\x04\x04", 2) if data[:2] == b"\xff\xd8" else -1
    if at < 0 or at + 8 > len(data):
        return out
    name = data[at + 7] + data[at + 7] % 2 or 4
    start = at + 8 + name
    end = min(start + int.from_bytes(data[at + 6 + name : at + 8 + name], "big"), len(data))
    here = data.find(b"\x1c\x02", start)
    while 0 <= here < end:
        if here + 5 <= len(data) and (field := IPTC.get(data[here + 2])):
            size = max(int.from_bytes(data[here + 3 : here + 5], "big", signed=True), 0)
            out.setdefault(field, []).append(data[here + 5 : here + 5 + size].decode("latin-1"))
        here = data.find(b"\x1c\x02", here + 1)
    return out


def as_value(v: object) -> dict:
    """A decoded value as the VALUE struct."""
    out = dict.fromkeys(("text", "number", "numerator", "denominator", "items"))
    if isinstance(v, str):
        return out | {"kind": "text", "text": v}
    if isinstance(v, list):
        return out | {"kind": "array", "items": [float(x) for x in v], "text": ",".join(f"{x:g}" for x in v)}
    if isinstance(v, Rational):
        return out | {"kind": "rational", "number": float(v), "text": f"{v:.15g}", "numerator": v.parts[0], "denominator": v.parts[1]}
    return out | {"kind": "number", "number": float(v), "text": f"{v:.15g}"}


@F.pandas_udf(SCHEMA)
def metadata(content: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """exif and iptc maps of a BINARY column (NULL bytes: empty maps)."""
    for batch in content:
        rows = [(decode_exif(b), decode_iptc(b)) for b in (x or b"" for x in batch)]
        yield pd.DataFrame({
            "exif": [{k: as_value(v) for k, v in e.items() if v is not None} for e, _ in rows],
            "iptc": [i for _, i in rows],
        })


def get_tag(exif: Column, tag: str) -> Column:
    """Text of a tag or NULL."""
    return F.try_element_at(exif, F.lit(tag))["text"]


def label(tag: str, code: Column) -> Column:
    """Label of a coded value, NULL when unknown."""
    table = F.create_map(*[F.lit(x) for kv in LABELS[tag].items() for x in kv])
    return F.try_element_at(table, code.cast("int"))


def pretty(exif: Column) -> Column:
    """``name : value`` lines; rationals with their parts, arrays by their length."""

    def line(e: Column) -> Column:
        v = e["value"]
        shown = (
            F.when(v["kind"] == "array", F.concat(F.lit("["), F.size(v["items"]).cast("string"), F.lit(" values]")))
            .when(v["kind"] == "rational", F.concat(v["text"], F.lit(" ["), v["numerator"].cast("string"), F.lit("/"), v["denominator"].cast("string"), F.lit("]")))
            .otherwise(v["text"])
        )
        return F.concat(e["key"], F.lit(" : "), shown, F.lit("\r\n"))

    return F.coalesce(F.array_join(F.transform(F.map_entries(exif), line), ""), F.lit(""))
