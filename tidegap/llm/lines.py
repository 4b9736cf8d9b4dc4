"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines chooses where chunks end, so the
same run of lines is cut alike wherever it stands and inserted lines shift nothing. A
long line is a chunk of its own. A chunk that occurs more than once in the corpus is
removed everywhere but at its first place (smallest doc_id, then position), after its
bytes have been compared.

Chunks miss the edges of a repeated passage, so pairs of neighbouring lines are looked
up as well: lines whose pairs all stand elsewhere before are a repeated run, which is
removed line by line if it has more than RUN_WORDS words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegap.llm.common import columns, discard, durable, fresh, plain, small_batches, trimmed, words

#: Mean lines of a chunk is about CUT; a chunk has MAX_LINES at most.
CUT, MAX_LINES = 3, 64
#: Characters that make a line a chunk of its own.
LONG_LINE = 120
#: A repeated run of lines is removed whole if it has more words than this.
RUN_WORDS = 50
#: The place of a pair of lines is PAIRS + the number of its first line.
PAIRS = 1 << 30
_M = (1 << 64) - 1


def chunks(text: str) -> list[tuple[str, bool]]:
    """The chunks of a text, whose lines joined by newlines are the text, and whether
    each may be removed: several lines that aren't blank, or a long one. A run of lines
    is cut only where it may be removed, so a single short line ends no chunk."""
    lines = text.split("\n")
    out, run, rolling, full = [], [], 0, 0
    for line in lines:
        if len(line) >= LONG_LINE:
            if run:
                out.append(_chunk(run, full))
            out.append((line, bool(line.strip())))
            run, rolling, full = [], 0, 0
            continue
        run.append(line)
        full += bool(line.strip())
        h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
        rolling, window = h, (rolling * 0x9E3779B97F4A7C15 + h) & _M
        if ((window >> 40) % CUT == 0 and full > 1) or len(run) == MAX_LINES:
            out.append(_chunk(run, full))
            run, full = [], 0
    if run:
        out.append(_chunk(run, full))
    return out


def _chunk(run: list[str], full: int) -> tuple[str, bool]:
    return "\n".join(run), full > 1


def _hash(part: str, place: int, bits: int = 64) -> int:
    return (xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass"), int(place >= PAIRS)) >> (64 - bits)) - (1 << 63)


def _parts(text: str) -> dict[int, str]:
    """What may be found again, by place: removable chunks, and where a text has more
    than RUN_WORDS words its pairs of neighbouring lines that aren't blank, with the
    blank ones between them. Long lines are chunks, so pairs of them aren't needed."""
    out = {i: c for i, (c, may) in enumerate(chunks(text)) if may}
    lines = text.split("\n")
    if len(lines) > 1 and len(words(text)) > RUN_WORDS:
        full = [i for i, x in enumerate(lines) if x.strip()]
        for a, b in zip(full, full[1:]):
            if min(len(lines[a]), len(lines[b])) < LONG_LINE:
                out[PAIRS + a] = "\n".join(lines[a : b + 1])
    return out


def _found(text: str, marks: list[dict] | None, bits: int = 64) -> list[tuple[dict, str]]:
    """Marks with the part at their place; marks of another text are left out."""
    parts = _parts(text) if marks else {}
    return [(m, parts[m["place"]]) for m in marks or () if m["place"] in parts and _hash(parts[m["place"]], m["place"], bits) == m["hash"]]


def dropped(text: str, marks: list[dict] | None, bits: int = 64) -> tuple[list[tuple[int, int]], set[int]]:
    """The lines of each chunk (from, to), and the numbers of the lines to remove."""
    spans, at = [], 0
    for c, _ in chunks(text):
        spans.append((at, at + c.count("\n") + 1))
        at = spans[-1][1]
    later = {m["place"]: m["origin"] for m, _ in _found(text, marks, bits) if not m["first"]}
    if not later:
        return spans, set()
    gone = {i for p in later if p < PAIRS for i in range(*spans[p])}
    origin = {spans[p][0]: o for p, o in later.items() if p < PAIRS}
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    long = [len(lines[i]) >= LONG_LINE for i in full]
    pair = [PAIRS + i in later for i in full[:-1]]

    def linked(k: int) -> bool:
        """Lines k and k + 1 stand together elsewhere before. A single short line at the
        edge of a long one goes only with the long one's own first place."""
        if full[k] in gone and full[k + 1] in gone:
            return True
        if not pair[k] or not (long[k] or long[k + 1]):
            return pair[k]
        whole, other = (full[k], k + 1) if long[k] else (full[k + 1], k - 1)
        return origin.get(whole) == later[PAIRS + full[k]] or (0 <= other < len(pair) and pair[other])

    start = 0
    for k in range(len(full)):
        if k + 1 == len(full) or not linked(k):
            if k > start and sum(len(words(lines[i])) for i in full[start : k + 1]) > RUN_WORDS:
                gone.update(range(full[start], full[k] + 1))
            start = k + 1
    return spans, gone


def _post(bits: int):
    """hash, doc_id, version, place of the parts of documents."""
    names = ["hash", "doc_id", "version", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, version, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows.extend((_hash(part, place, bits), doc_id, version, place) for place, part in _parts(value.as_py() or "").items())
                if len(rows) > 50_000:
                    yield _columns(names, *zip(*rows))
                    rows = []
            if rows:
                yield _columns(names, *zip(*rows))

    return run


def _columns(names: list[str], *cols: list) -> pa.RecordBatch:
    kinds = {"place": pa.int32(), "chunk": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, cols, strict=True)], names)


def _marked(bits: int):
    """hash and text of marked parts, once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for value, marks in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found.update((m["hash"], part) for m, part in _found(value.as_py() or "", marks, bits))
            yield _columns(["hash", "chunk"], [h for h, _ in found], [c for _, c in found])

    return run


def dedup_lines(docs: DataFrame, counts: bool = True, bits: int = 64) -> DataFrame:
    """The columns of ``docs`` with the shortened text, and n_chunks, n_removed_chunks,
    n_removed_lines if ``counts`` (which then replace columns of these names).

    Every row stays, if only with an empty text; n_chars, where present, is the new
    length. A null text stays null. Rows with a null doc_id are left as they are. Rows
    that share a doc_id and a text count as one document, so they keep what one of them
    keeps; with different texts they are different documents (versions, in the order of
    the texts' hashes). Two chunks with one hash (of ``bits`` bits) but different bytes are
    both kept. n_removed_chunks counts the chunks that lost all their lines. An empty table
    gives no rows; the parts of a very long text take some 13 times its size
    in a worker (measured on 5 MB).
    """
    small_batches(docs.sparkSession)
    if counts:
        docs = docs.select(*columns([n for n in docs.columns if n.lower() not in COUNTS]))
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text")
    posts = durable(plain(rows).mapInArrow(trimmed(_post(bits)), "hash long, doc_id long, version long, place int"), "chunks")
    first = F.min(F.struct("doc_id", "version", "place"))
    repeated = durable(posts.groupBy("hash").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1").drop("n"), "repeated")
    found = durable(_marks(posts, repeated), "marks")
    discard(posts, repeated)
    joined = _with_marks(docs, found)
    marks = F.col(joined.columns[-1])
    seen = joined.where(marks.isNotNull()).select("text", marks).mapInArrow(trimmed(_marked(bits)), "hash long, chunk string")
    clash = durable(seen.distinct().groupBy("hash").count().where("count > 1").select("hash"), "clash")
    if clash.head(1):
        clashing, clear = joined, found.join(clash, F.col("m.hash") == F.col("hash"), "left_anti")
        joined = _with_marks(docs, clear)
        discard(clashing)
    discard(found, clash)
    return _rewrite(docs, joined, counts, bits)


def _marks(posts: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc_id, version and m for each repeated part: hash, place, whether it's the first
    place, and the row of the first place (origin)."""
    is_first = F.col("first") == F.struct("doc_id", "version", "place")
    origin = F.xxhash64("first.doc_id", "first.version")
    m = F.struct("hash", "place", is_first.alias("first"), origin.alias("origin")).alias("m")
    return posts.join(repeated, "hash").select("doc_id", "version", m)


def _with_marks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with an array of their marks, as last column."""
    doc, version, name = (fresh(n, docs.columns) for n in ("_doc", "_version", "_marks"))
    marks = found.groupBy(F.col("doc_id").alias(doc), F.col("version").alias(version)).agg(F.collect_set("m").alias(name))
    same = (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(version))
    return durable(docs.join(marks, same, "left").drop(doc, version), "marked")


def _rewrite(docs: DataFrame, joined: DataFrame, with_counts: bool, bits: int) -> DataFrame:
    names = docs.columns
    at = names.index("text")
    extra = COUNTS if with_counts else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for value, marks in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                spans, gone = dropped(value, marks, bits) if value is not None else ([], set())
                if gone:
                    value = "\n".join(x for i, x in enumerate(value.split("\n")) if i not in gone)
                texts.append(value)
                counts.append((len(spans), sum(gone.issuperset(range(*x)) for x in spans), len(gone)))
            own = list(batch.columns[: len(names)])
            own[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(extra)))], [*names, *extra])

    schema = T.StructType([*docs.schema, *(T.StructField(c, T.LongType()) for c in extra)])
    out = plain(joined).mapInArrow(trimmed(run), schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


COUNTS = ["n_chunks", "n_removed_chunks", "n_removed_lines"]
