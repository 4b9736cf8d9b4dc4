"""Quality rules by compression bands.

zstandard ratios (compressed over original bytes) of the whole text and of fixed chunks:
repetitive text compresses too well, noise hardly at all. How far a text compresses
depends on its length, so each length class has its own band, and a document is
rejected if the whole lies outside of it or too many chunks do.

Limits come from a calibration on 61,282 documents (sf0.1 and check_s), of which 50 words or
more and the base rules left 54,214. The least ratio of a class lies 0.02 below the smallest
of documents labelled good (0.508 to 512 bytes, 0.483 to 1.5 kB, 0.450 to 4 kB, 0.434 to
8 kB, 0.415 beyond; full chunks 0.445), so that symbols strewn over a text and lines said
again show: they compress to 0.36 to 0.45 from 4 kB on. Below that length they overlap with
clean text, and short texts are hardly ever told apart. Largest ratios lie between clean
documents (0.756 to 512 bytes, then 0.687, 0.612, 0.567, 0.512 to 8 kB, 0.471 beyond; full
chunks 0.515) and noise cut by spaces, at the upper end of a class: base64 0.80, 0.76, 0.73,
0.72, printable ASCII 0.86, 0.81, 0.79, 0.78. Random lower-case letters (0.58 to 0.65 from
512 bytes) are told apart from 4 kB on only. Texts of another kind (code, other scripts) need
a calibration of their own: pass ``bands`` and ``chunk_band``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegap.llm.common import small_batches, trimmed

CHUNK = 4096
LEVEL = 1
#: (bytes up to, least ratio, largest ratio) for whole texts; the last has no end.
BANDS = (
    (256, 0.48, 0.83), (512, 0.48, 0.78), (1024, 0.48, 0.72), (1536, 0.46, 0.67), (2048, 0.45, 0.67), (3072, 0.43, 0.62), (4096, 0.43, 0.62),
    (8192, 0.41, 0.57), (12288, 0.40, 0.57), (16384, 0.39, 0.57), (None, 0.39, 0.56),
)
#: The band of full chunks, and the share of bytes whose chunks may lie outside of theirs.
CHUNK_BAND, CHUNK_SHARE = (0.42, 0.57), 0.5
#: A last chunk of more bytes than this is judged, by the band of its length.
LEAST_TAIL = 256
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
_SPACES = " \t\n\x0b\x0c\r"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    ws = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    n, repeats = len(ws), 0
    if n > 3:
        ids: dict[bytes, int] = {}
        of = np.fromiter((ids.setdefault(w, len(ids)) for w in ws), np.int64, n)
        # two 32-bit numbers make a pair exactly; pairs are numbered anew before the third
        _, pair = np.unique(of[:-2] << 32 | of[1:-1], return_inverse=True)
        _, gram, often = np.unique(pair << 32 | of[2:], return_inverse=True, return_counts=True)
        twice = often[gram] > 1
        if twice.any():
            covered = np.zeros(n, bool)
            for i in range(3):
                covered[i : n - 2 + i] |= twice
            repeats = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


def _band(n: int, bands: tuple = BANDS) -> tuple[float, float]:
    return next((lo, hi) for top, lo, hi in bands if top is None or n <= top)


def in_bands(data: bytes, compress, bands: tuple = BANDS, chunk_band: tuple[float, float] = CHUNK_BAND) -> tuple[float, float, bool]:
    """Whole ratio, share of bytes (of judged chunks) in chunks outside their band, verdict."""
    if not data:
        return 0.0, 0.0, False
    ratio = len(compress(data)) / len(data)
    low, high = _band(len(data), bands)
    view, bad, judged = memoryview(data), 0, 0
    for at in range(0, len(data), CHUNK) if len(data) >= CHUNK else ():
        part = view[at : at + CHUNK]
        n = len(part)
        if n > LEAST_TAIL:
            lo, hi = chunk_band if n == CHUNK else _band(n, bands)
            judged += n
            bad += n * (not lo <= len(compress(part)) / n <= hi)
    share = bad / judged if judged else 0.0
    return ratio, share, low <= ratio <= high and share <= CHUNK_SHARE


def quality(docs: DataFrame, bands: tuple = BANDS, chunk_band: tuple[float, float] = CHUNK_BAND) -> DataFrame:
    """doc_id, base counts, ratio, bad_chunk_share, base_failed and kept for every row.

    A null text has no words. base_failed: fewer than 50 words, or more than half of
    the words in repeated 3-word windows; such rows are never kept. A ratio that equals a
    limit lies in its band, and so does a share of CHUNK_SHARE. Rows are independent, other
    columns are ignored, and an empty table gives no rows. A text's windows are
    compared exactly, in some 170 bytes of memory a word (measured on 5 MB).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                for value in part.column(1):
                    text = value.as_py() or ""
                    counts = base_counts(text)
                    ratio, share, ok = in_bands(text.encode("utf-8", "surrogatepass"), compress, bands, chunk_band)
                    failed = counts[0] < MIN_WORDS or 100 * counts[4] > 50 * counts[0]
                    rows.append((*counts, ratio, share, failed, ok and not failed))
                kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)]], NAMES)

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{n} long" for n in NAMES[1:6])
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, {counts}, ratio double, bad_chunk_share double, base_failed boolean, kept boolean")


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "bad_chunk_share", "base_failed", "kept"]
