"""MinHash near-duplicates by an inverted join on signature coordinates.

Texts become sets of word shingles, sets become signatures of K minima. A document is
posted under its rarest coordinate-value pairs only: two signatures that agree in at
least T of K places must meet at least S times among the K - T + S rarest of each
(prefix merging), whatever the order of rarity is, so a bounded sketch of frequencies
serves as order. T is the largest count that a pair at the similarity limit misses with
a probability of at most MISS. Pairs are then counted on whole signatures and confirmed
on whole sets.

Copies: equal sets are one node from the start. Groups of near copies are first linked
to leaders of each large posting list, its most typical node (whose keys are the most
frequent: the original of its copies) and its smallest one (linear work); only rows of
a list that still lie in different components are then paired (skip merging), so a group
is not expanded into all its pairs, and no link between components is left out. Rows of
large lists are paired only where they share one of the rarest shingles of both sets, as
any two sets at the limit do: near copies that edits have carried beyond the limit have
rare shingles of their own, so their number of pairs doesn't grow with its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegap.llm.common import discard, durable, small_batches, trimmed, words

K = 128
MISS = 1e-5
SHARED = 2
#: Least and most bits of the index of the sketches of keys and of shingles, most of a Bloom
#: filter's: they grow with what they count up to 64 MB, 32 MB and 8 MB.
SKETCH_BITS, RARE_BITS, BLOOM_BITS = (16, 24), (16, 24), 26
LARGE = 12
_TILE = 1 << 15


@lru_cache
def match_threshold(percent: int, k: int = K, miss: float = MISS) -> int:
    """The largest T with P(Binomial(k, percent/100) < T) <= miss."""
    p, below = percent / 100, 0.0
    for t in range(k + 1):
        below += comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > miss:
            return max(t, 1)
    return k


def _constants(n: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return np.random.RandomState(20240607).randint(1, 2**62, n, dtype=np.int64).astype(np.uint64) * np.uint64(4) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """64-bit hashes of words, bounded in number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 120_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingle_set(text: str | None, size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` lower-cased words; a
    shorter text is one shingle, a text without words none."""
    ws = words(text)
    ws = b" ".join(ws).lower().split() if ws else ws
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    c = _constants(size)
    n = max(len(ws) - size + 1, 1)
    s = np.full(n, min(len(ws), size), np.uint64)
    for i in range(min(size, len(ws))):
        s += h[i : i + n] * c[i]
    return np.unique(mix(s))


def signatures(flat: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """(len(starts), k) minima of non-empty runs of ``flat``, as 32 high bits."""
    out = np.empty((len(starts), k), np.uint32)
    for i, c in enumerate(_constants(k + 8)[8:]):
        out[:, i] = np.minimum.reduceat(flat * c, starts) >> np.uint64(32)
    return out


def _sketch(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()

        def tile(ids, sets):
            full = [s for s in sets if len(s)]
            sig = iter(())
            if full:
                lens = np.array([len(s) for s in full])
                sig = iter(signatures(np.concatenate(full), np.cumsum(lens) - lens, k))
            nodes = [_node(s) if len(s) else None for s in sets]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "node", "sig"],
            )

        for batch in batches:
            ids, sets, room = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(text.as_py(), size, hashes)
                ids.append(doc_id)
                sets.append(s)
                room += len(s)
                if room >= _TILE or len(ids) >= 4096:
                    yield tile(ids, sets)
                    ids, sets, room = [], [], 0
            if ids:
                yield tile(ids, sets)

    return run


def _keys(sig: np.ndarray) -> np.ndarray:
    """64-bit keys of coordinate-value pairs."""
    place = np.arange(sig.shape[1], dtype=np.uint64) << np.uint64(32)
    return mix(sig.astype(np.uint64) | place)


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, k)


def _table(df: DataFrame, fill, dtype, size: int, join) -> np.ndarray:
    """A bounded array over all rows of df: ``fill`` adds a batch to a partition's array,
    arrays are joined slice by slice, and only the result comes to the driver. Of a slice
    with few entries only these are sent, so small partitions send little."""
    slices = 64
    width = size // slices

    def partial(batches):
        total = np.zeros(size, dtype)
        for batch in batches:
            if batch.num_rows:
                fill(total, batch)
        for i in range(slices):
            part = total[i * width : (i + 1) * width]
            at = np.flatnonzero(part).astype(np.uint32)
            if len(at):
                few = at.nbytes + len(at) * part.itemsize < part.nbytes
                yield _slices([i], [at.tobytes() if few else None], [(part[at] if few else part).tobytes()])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, at, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                total, part = sums.setdefault(i, np.zeros(width, dtype)), np.frombuffer(b.as_buffer(), dtype)
                if at.is_valid:
                    at = np.frombuffer(at.as_buffer(), np.uint32)
                    total[at] = join(total[at], part)
                else:
                    total[:] = join(total, part)
        for i, v in sums.items():
            yield _slices([i], [None], [v.tobytes()])

    kind = "slice int, at binary, part binary"
    table = np.zeros(size, dtype)
    for r in df.mapInArrow(trimmed(partial), kind).repartition(16, "slice").mapInArrow(trimmed(merge), kind).collect():
        table[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["part"], dtype)
    return table


def _slices(i: list[int], at: list[bytes | None], part: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(at, pa.binary()), pa.array(part, pa.binary())], ["slice", "at", "part"])


def _bits(entries: int, least: int, most: int) -> int:
    """Bits of a table's index for so many entries."""
    return min(max(int(entries).bit_length(), least), most)


def _saturating(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a.astype(np.int64) + b, np.iinfo(a.dtype).max).astype(a.dtype)


def frequency_sketch(classes: DataFrame, k: int) -> np.ndarray:
    """Counts of all keys in buckets: an array that grows with the input up to a bound."""
    bits = _bits(classes.count() * k // 32, *SKETCH_BITS)

    def fill(total, batch):
        at = (_keys(_matrix(batch.column(0), k)) >> np.uint64(64 - bits)).ravel().astype(np.int64)
        total[:] = _saturating(total, np.bincount(at, minlength=len(total)))

    return _table(classes.select("sig"), fill, np.int32, 1 << bits, _saturating)


def _bloom_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return np.stack([h >> np.uint64(64 - bits), mix(h + np.uint64(1)) >> np.uint64(64 - bits)]).astype(np.int64)


def _sets(texts: DataFrame, classes: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, set of the given nodes (distinct). Only rows with a node's smallest doc_id are
    shingled: a Bloom filter of their ids picks them, so that texts aren't shuffled, unless
    the ids are too many for it; then a join does. Rows without an id are always looked at."""
    wanted = durable(classes.join(nodes, "node", "left_semi").select("node", "rep"), "wanted")
    needed = wanted.where("rep is not null").select("rep")
    n = needed.count()
    bits = _bits(16 * n, 16, BLOOM_BITS)
    bloom = None
    if 8 * n <= 1 << BLOOM_BITS:

        def fill(total, batch):
            at = _bloom_bits(batch.column(0).to_numpy(zero_copy_only=False), bits).ravel()
            np.bitwise_or.at(total, at >> 3, (1 << (at & 7)).astype(np.uint8))

        bloom = texts.sparkSession.sparkContext.broadcast(_table(needed, fill, np.uint8, 1 << (bits - 3), np.bitwise_or))
    else:
        near = needed.distinct().withColumnRenamed("rep", "doc_id")
        texts = texts.join(near, "doc_id", "left_semi").unionByName(texts.where("doc_id is null"))

    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            rows = range(batch.num_rows)
            if bloom is not None:
                ids = batch.column(0)
                at = _bloom_bits(ids.fill_null(0).to_numpy(zero_copy_only=False), bits)
                may = ((bloom.value[at >> 3] >> (at & 7)) & 1).all(axis=0) | ids.is_null().to_numpy(zero_copy_only=False)
                rows = np.flatnonzero(may).tolist()
            nodes, sets, room = [], [], 0
            for i in rows:
                s = shingle_set(batch.column(1)[i].as_py(), size, hashes)
                if len(s):
                    nodes.append(_node(s))
                    sets.append(s.tobytes())
                    room += len(s)
                if room > _TILE:
                    yield _set_batch(nodes, sets)
                    nodes, sets, room = [], [], 0
            yield _set_batch(nodes, sets)

    made = texts.mapInArrow(trimmed(run), "node long, set binary")
    out = durable(made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    discard(wanted)
    if bloom is not None:
        bloom.destroy()
    return out


def _set_batch(nodes: list[int], sets: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])


def _node(s: np.ndarray) -> int:
    """The identity of a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """node, n, place, shingle: the rarest shingles of each set, rarest first.

    The order is one for all sets: by a bounded table of counts over these sets (shingles
    of a bucket are counted together), then by hash. A set's first n - ceil(percent% of n)
    + 1 shingles hold one of any other set at the similarity limit.
    """
    total = sets.agg(F.coalesce(F.sum(F.octet_length("set")), F.lit(0))).head()[0] // 8
    bits = _bits(2 * total, *RARE_BITS)
    shift = np.uint64(64 - bits)
    limit = np.iinfo(np.uint16).max

    def places(batch, i):
        s = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint64)
        return s, (s >> shift).astype(np.int64)

    def fill(total, batch):
        for i in range(batch.num_rows):
            at, n = np.unique(places(batch, i)[1], return_counts=True)
            total[at] = np.minimum(total[at].astype(np.int64) + n, limit)

    counts = sets.sparkSession.sparkContext.broadcast(_table(sets, fill, np.uint16, 1 << bits, _saturating))

    def run(batches):
        for batch in batches:
            kept, lens, sizes = [], [], []
            for i in range(batch.num_rows):
                s, at = places(batch, i)
                first = np.lexsort((s, counts.value[at]))[: len(s) * (100 - percent) // 100 + 1]
                kept.append(s[first])
                lens.append(len(first))
                sizes.append(len(s))
            if kept:
                place = np.concatenate([np.arange(n) for n in lens])
                node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.array(np.repeat(sizes, lens)), pa.array(place), pa.array(np.concatenate(kept).view(np.int64))],
                    ["node", "n", "place", "shingle"],
                )

    out = durable(sets.mapInArrow(trimmed(run), "node long, n long, place long, shingle long"), "rare")
    counts.destroy()
    return out


def postings(classes: DataFrame, k: int, prefix: int, sketch: np.ndarray) -> DataFrame:
    """key, node, n_shingles, typical: each node under its ``prefix`` rarest keys;
    ``typical`` sums the logarithms of the frequencies of all its keys."""
    shared = classes.sparkSession.sparkContext.broadcast(sketch)  # 4 bytes a bucket
    shift = np.uint64(64 - int(np.log2(len(sketch))))

    def run(batches):
        counts = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys = _keys(_matrix(part.column(2), k))
                often = counts[(keys >> shift).astype(np.int64)]
                order = np.lexsort((keys, often), axis=1)[:, :prefix]
                typical = np.repeat(np.log2(np.maximum(often, 1)).sum(axis=1).astype(np.float32), prefix)
                picked = np.take_along_axis(keys, order, axis=1)
                node, n = (np.repeat(part.column(i).to_numpy(zero_copy_only=False), prefix) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(picked.ravel().view(np.int64)), pa.array(node), pa.array(n), pa.array(typical)], ["key", "node", "n_shingles", "typical"])

    out = durable(classes.select("node", "n_shingles", "sig").mapInArrow(trimmed(run), "key long, node long, n_shingles long, typical float"), "postings")
    shared.destroy()
    return out


def _halves(rows: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """rows twice, its columns suffixed with _a and _b."""
    return tuple(rows.select(*[F.col(n).alias(f"{n}_{k}") for n in names]) for k in "ab")


def _meet(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of SHARED keys or more but two components, of sizes that allow a link."""
    x, y = _halves(durable(rows.select("key", "node", "n_shingles", "comp"), "rows"), "key", "node", "n_shingles", "comp")
    able = F.expr(f"key_a = key_b and node_a < node_b and comp_a != comp_b and least(n_shingles_a, n_shingles_b) * 100 >= greatest(n_shingles_a, n_shingles_b) * {percent}")
    met = x.join(y, able).groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).count()
    return met.where(F.col("count") >= SHARED).select("a", "b")


def _meet_rare(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of two components that share a shingle among those that two sets with
    the overlap of a link must share: of n shingles in order of rarity and an overlap of
    o, the first common one is among the first n - o + 1."""
    names = "shingle", "place", "n", "node", "comp"
    x, y = _halves(durable(rows.select(*names), "rare"), *names)
    o = f"(({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent})"
    able = F.expr(f"shingle_a = shingle_b and node_a < node_b and comp_a != comp_b and place_a <= n_a - {o} and place_b <= n_b - {o}")
    return x.join(y, able).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _alike(pairs: DataFrame, classes: DataFrame, k: int, t: int) -> DataFrame:
    """Pairs a, b whose signatures agree in at least t places."""
    sig = classes.select("node", "sig")
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column(2), k) == _matrix(batch.column(3), k)).sum(axis=1) >= t
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(same)), batch.column(1).filter(pa.array(same))], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(trimmed(run), "a long, b long")


def _confirm(pairs: DataFrame, texts: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose whole sets reach the similarity."""
    sets = _sets(texts, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), size)

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    out = durable(both.select("a", "b", "x", "y").mapInArrow(trimmed(check), "a long, b long"), "links")
    discard(sets)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node that each node of an edge list reaches.

    Labels shrink over edges and jump over labels, so rounds grow with the logarithm of
    a component's diameter. Each round ends in a written table.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = durable(lower.join(jump, "comp").select("node", F.least("comp", "next").alias("comp"), "old"), "labels")
        discard(labels)
        labels = new
        if not new.where("comp != old").head(1):
            discard(both)
            out = new.drop("old")
            out.written_at = new.written_at
            return out


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Links: 100 * |intersection| >= percent * |union| of shingle sets. component_id is the
    smallest doc_id reachable. Null and wordless texts are empty sets, linked with
    nothing. Equal rows share a component; a null doc_id can't be a component_id unless
    all of its component are null. Other columns of ``docs`` are ignored; an empty table
    gives no rows. A very long text takes some 150 bytes of memory a word (measured on 5 MB).
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    t = match_threshold(percent, k)
    prefix = min(k - t + SHARED, k)
    sketches = durable(texts.mapInArrow(trimmed(_sketch(shingle, k)), "doc_id long, n_shingles long, node long, sig binary"), "sketches")
    full = sketches.where("node is not null")
    classes = durable(full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")
    posts = postings(classes, k, prefix, frequency_sketch(classes, k))
    lists = durable(posts.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max_by("node", F.struct("typical", "node")).alias("hi")).where("n > 1"), "lists")

    large = lists.where(F.col("n") >= LARGE).select("key", F.array("lo", "hi").alias("leaders"))
    star = posts.join(large, "key").select(F.col("node").alias("a"), F.explode("leaders").alias("b")).where("a != b").distinct()
    alike = durable(_alike(star, classes, k, t), "pairs")
    linked = _confirm(alike, texts, classes, shingle, percent)
    first = components(linked)
    discard(alike)

    met = posts.drop("typical").join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    keys = met.join(lists.select("key", "n"), "key").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.first("n").alias("n"))
    open_keys = durable(keys.where("lo != hi").select("key", (F.col("n") >= LARGE).alias("large")), "open")
    rest = durable(met.join(open_keys, "key"), "rest")
    discard(posts, lists, first, open_keys)
    large = durable(rest.where("large").select("node", "comp").distinct(), "large")
    sets = _sets(texts, classes, large.select("node"), shingle)
    rare = rare_shingles(sets, percent)
    pairs = durable(_meet(rest.where("not large"), percent).union(_meet_rare(rare.join(large, "node"), percent)).distinct(), "met")
    discard(sets, rare, rest, large)
    alike = durable(_alike(pairs, classes, k, t), "pairs")
    more = _confirm(alike, texts, classes, shingle, percent)
    discard(pairs, alike)
    comps = components(linked.union(more))

    low = classes.join(comps, "node").groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = comps.join(low, "comp").select("node", "component_id")
    own = classes.where("rows > 1").join(named, "node", "left_anti").select("node", F.col("rep").alias("component_id"))
    table = durable(named.union(own), "components")
    discard(linked, more, comps, classes)
    out = sketches.select("doc_id", "n_shingles", "node").join(table, "node", "left")
    comp = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))
