"""Approximate nearest neighbours by collision counting.

Vectors are dealt into blocks, each with, for every random projection, an array of its
vectors sorted by the projected value. Around a query's own value a window collects
colliding vectors; widening the windows (virtual rehashing) needs no new index, only the
newly covered ends are counted. A vector that collides in enough projections is verified
by its exact cosine. At window radius R a vector no farther than R reaches the threshold
with a probability of at least that of Z deviations, so the search of a block ends once
R covers the distance of the k-th best vector found so far. A first bound of that distance
comes from a bounded sample; it gives a radius only, every result comes from collisions.

A stated set of queries meets all blocks, a block and a group of queries at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegap.llm.common import durable, small_batches

PROJECTIONS, WIDTH, Z = 64, 1.0, 1.75
STEP, LEVELS = 1.1, 3
#: Vectors of a block, queries sent to it at once and searched in one round.
BLOCK, QUERY_GROUP, ROUND = 16_384, 8_192, 256
#: More than what rounding to single precision changes a cosine or a distance by.
ROUGH = 2e-3
#: Rows of the sample that bounds distances: PILOT at most, and one row in PILOT_SHARE.
PILOT, PILOT_SHARE = 4_096, 8


def usable(vector: Column) -> Column:
    """Not null, nowhere null or non-finite, not zero (checked in double precision)."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _unit(m: np.ndarray) -> np.ndarray:
    big = np.abs(m).max(axis=1, keepdims=True)
    m = m / big
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision; equal rows get equal values wherever they stand."""
    dot = (rows * query).sum(axis=1)
    return dot / (np.sqrt((rows * rows).sum(axis=1)) * math.sqrt((query * query).sum()))


def threshold(m: int, width: float = WIDTH, z: float = Z) -> int:
    """Collisions of m that a vector at the window's radius reaches, up to z deviations."""
    p = math.erf(width / math.sqrt(2))
    return max(1, math.floor(m * p - z * math.sqrt(m * p * (1 - p))))


class Block:
    """The sorted projection arrays of a block."""

    def __init__(self, vectors: np.ndarray, m: int = PROJECTIONS):
        self.vectors, self.unit = vectors, _unit(vectors)
        self.rough = self.unit.astype(np.float32)
        self.axes = np.random.RandomState(99).normal(size=(vectors.shape[1], m))
        values = (self.unit @ self.axes).T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=1)
        self.least = threshold(m)

    def windows(self, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end place (queries, projections) in each array within ``radius``."""
        out = np.empty((2, *centres.shape), np.int64)
        for j, s in enumerate(self.sorted):
            out[0, :, j] = s.searchsorted(centres[:, j] - WIDTH * radius, "left")
            out[1, :, j] = s.searchsorted(centres[:, j] + WIDTH * radius, "right")
        return out[0], out[1]

    def search(self, queries: np.ndarray, k: int, far: np.ndarray, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and exact cosines of the k best found (more on ties);
        ``far`` bounds the k-th distances between unit vectors; ``own`` are the queries' own
        places (-1: none). Windows of all queries are widened in rounds; a round counts only
        what the wider windows add at their two ends."""
        units = _unit(queries)
        centres, rough = units @ self.axes, units.astype(np.float32)
        total, n = len(queries), len(self.vectors)
        counts = np.zeros((total, n), np.int16)
        seen = np.zeros((total, n), bool)
        seen[np.flatnonzero(own >= 0), own[own >= 0]] = True
        places: list[list[np.ndarray]] = [[] for _ in range(total)]
        near: list[list[np.ndarray]] = [[] for _ in range(total)]
        best = [np.empty(0)] * total
        far = far.copy()
        radius = far / STEP ** (LEVELS - 1)
        lo = hi = np.zeros(centres.shape, np.int64)
        active, began = np.arange(total), False
        while len(active):
            a, b = self.windows(centres[active], radius[active])
            if not began:
                lo, hi, began = a.copy(), a.copy(), True
            after = []
            for i, q in enumerate(active.tolist()):
                new = [o[x:y] for o, x, y in zip(self.order, a[i], lo[q])] + [o[x:y] for o, x, y in zip(self.order, hi[q], b[i])]
                counts[q] += np.bincount(np.concatenate(new), minlength=n).astype(np.int16)
                lo[q], hi[q] = a[i], b[i]
                found = np.flatnonzero((counts[q] >= self.least) & ~seen[q])
                if len(found):
                    seen[q][found] = True
                    places[q].append(found)
                    near[q].append(self.rough[found] @ rough[q])
                    best[q] = np.sort(np.concatenate([best[q], near[q][-1]]))[-k:]
                if len(best[q]) == k:
                    far[q] = min(far[q], math.sqrt(max(0.0, 2 - 2 * best[q][0])) + ROUGH)
                if radius[q] < far[q]:
                    after.append(q)
            active = np.array(after, np.int64)
            radius[active] = np.minimum(radius[active] * STEP, far[active])
        out = []
        for q, found in enumerate(places):
            at = np.concatenate([np.empty(0, np.int64), *found])
            if len(at) > k:
                score = np.concatenate(near[q])
                at = at[score >= np.partition(score, -k)[-k] - ROUGH]
            out.append((at, cosine(self.vectors[at], queries[q])))
        return out


def _doubles(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def bounds(queries: np.ndarray, uids: np.ndarray, sample: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """A bound of each query's k-th distance by the sample (uids, unit vectors), the
    query's own row left out; 2, which bounds any distance, if the sample is too small."""
    out = np.full(len(queries), 2.0)
    if len(sample[0]) > k:
        near = _unit(queries) @ sample[1].T
        near[uids[:, None] == sample[0][None, :]] = -2
        kth = np.partition(near, -k, axis=1)[:, -k]
        out = np.where(kth > -2, np.sqrt(np.maximum(0.0, 2 - 2 * kth)) + 1e-9, 2.0)
    return out


def nearest(table: DataFrame, queries: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the k nearest rows found per query.

    ``queries`` is the condition that makes a row a query; candidates are all rows but
    the query's own, ties go to the smaller id. Unusable vectors (null, zero, null or
    non-finite components) and vectors whose length is not the most common one take no
    part. Repeated rows are candidates like others; a repeated query row is answered once
    per row, as is each row with a null id that is a query. With fewer candidates than k,
    all are returned; an empty table gives none; other columns are ignored.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("q"))
    rows = rows.where(usable(F.col("v"))).withColumn("uid", F.monotonically_increasing_id())
    rows = durable(rows, "vectors")
    small_batches(spark, 4096, 8 << 20)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head(1)
    kind = "query_id long, query_uid long, id long, uid long, score double"
    final = Window.partitionBy("query_uid").orderBy(F.desc("score"), "id", "uid")
    shape = rows.where(F.size("v") == common[0]["d"]) if common else rows
    total = sum(r["count"] for r in common)
    n_blocks = max(1, math.ceil(total / BLOCK))
    n_queries = shape.where("q").count()
    n_groups = max(1, math.ceil(n_queries / QUERY_GROUP))
    pilot = shape.orderBy(F.xxhash64("uid"), "uid").limit(min(PILOT, total // PILOT_SHARE)).select("uid", "v").toArrow()
    sample = spark.sparkContext.broadcast((np.asarray(pilot["uid"]), _unit(_doubles(pilot["v"]))))  # bounded by PILOT rows

    def deal(col: str, n: int):
        return F.pmod(F.xxhash64(col, F.lit(7)), F.lit(n)).cast("int")

    blocks = shape.select("id", "uid", "v", deal("uid", n_blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group"))
    asked = shape.where("q").select("id", "uid", "v", deal("uid", n_groups).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, uids, block = right["id"].to_pylist(), np.asarray(right["uid"]), Block(_doubles(right["v"]))
            place = {u: i for i, u in enumerate(uids.tolist())}
            q_ids, q_uids, vectors = left["id"].to_pylist(), np.asarray(left["uid"]), _doubles(left["v"])
            for at in range(0, len(q_ids), ROUND):
                part = slice(at, at + ROUND)
                own = np.array([place.get(u, -1) for u in q_uids[part].tolist()])
                answers = block.search(vectors[part], k, bounds(vectors[part], q_uids[part], sample.value, k), own)
                for q_id, q_uid, (found, score) in zip(q_ids[part], q_uids[part].tolist(), answers, strict=True):
                    rows = [(ids[i], int(uids[i]), float(s)) for i, s in zip(found.tolist(), score)]
                    rows.sort(key=lambda f: (-f[2], f[0] is not None, f[0] or 0, f[1]))
                    out += [(q_id, q_uid, *f) for f in rows[:k]]
        kinds = [pa.int64()] * 4 + [pa.float64()]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["query_id", "query_uid", "id", "uid", "score"])

    found = asked.groupBy("block", "group").cogroup(blocks.groupBy("block", "group")).applyInArrow(search, kind)
    # WindowGroupLimit keeps k rows per query before the shuffle
    ranked = found.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def search_table(table: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``nearest`` for the rows whose id is divisible by ``every``."""
    return nearest(table, F.coalesce(F.col("vec_id") % every == 0, F.lit(False)), k=k)
