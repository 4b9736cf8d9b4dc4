"""Mixing sources to target weights with hash-threshold histograms. DataFrame functions only.

Every document has a 60-bit hash of its id. A source's budget beyond whole repeats is a
threshold on that hash: sizes are summed by source and the hash's leading digits, the
running sum shows the bucket that the budget ends in, and only that bucket's documents
are summed again by their next digits. The filter is then a comparison per document:
no documents are sorted, and a smaller budget always keeps a subset of a larger one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegap.llm.common import WORD, durable

BITS = 60
LEVELS = (12, 12, 12, 12, 12)
MAX_REPEATS = 3
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    """Words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of an id's text; NULL counts as the empty text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target of a table of source sizes.

    Sources by code point, null last, take the weights in turn. With targets stopped at
    cap * size and the excess reshared by weight until none is above, target =
    min(cap * size, level * weight): sources are full in order of cap * size / weight,
    and the level follows from the first that is not.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.row_number().over(by_name) - 1
    rows = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * cap).withColumn("_r", F.col("_cap") / F.col("_w"))
    fill = Window.orderBy("_r", F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    share = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    rows = rows.withColumn("_level", left / share)
    rows = rows.withColumn("_i", F.row_number().over(fill))
    level = F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_i", "_level"))).over(whole)["_level"]
    target = F.least(F.col("_cap").cast("double"), F.col("_w") * level)
    return rows.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _thresholds(slim: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, base, threshold: documents with a hash below it get one repeat more.

    At each level the whole buckets before the boundary are kept; at the last one the
    boundary value itself is kept if that brings the sum nearer to the budget.
    """
    state = budgets.select("source", "base", "rest", F.lit(0).cast("long").alias("low"))
    done = 0
    for bits in LEVELS:
        done += bits
        width = 1 << (BITS - done)
        s = _small(state.withColumnRenamed("source", "_s"))
        inside = slim.join(s, _same("source", "_s")).where((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + width * (1 << bits)) & (F.col("rest") > 0))
        cells = inside.groupBy("source", F.expr(f"hash div {width}").alias("cell")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("cell")
        sums = cells.withColumn("cum", F.sum("n").over(run)).withColumnRenamed("source", "_c")
        joined = state.join(sums, _same("source", "_c"), "left")
        over = F.col("cum") > F.col("rest")
        state = durable(
            joined.groupBy("source", "base", "rest", "low").agg(
                F.min(F.when(over, F.col("cell"))).alias("_cell"),
                F.max(F.when(~over, F.col("cum"))).alias("_sum"),
                F.min_by("n", F.when(over, F.col("cell"))).alias("_n"),
                F.max("cell").alias("_last"),
            ).select(
                "source", "base",
                (F.col("rest") - F.coalesce("_sum", F.lit(0))).alias("rest"),
                # all of it fits: the threshold is the end of this range
                F.coalesce(F.col("_cell") * width, F.when(F.col("_last").isNotNull(), F.col("low") + width * (1 << bits)), F.col("low")).alias("low"),
                F.col("_n"), F.col("_cell"),
            ),
            "mix",
        )
    near = F.col("_cell").isNotNull() & (F.col("_n") - F.col("rest") < F.col("rest"))
    return state.select("source", "base", F.when(near, F.col("low") + 1).otherwise(F.col("low")).alias("threshold"))


def _small(table: DataFrame) -> DataFrame:
    """A table with a row per source, broadcast if a count shows that it is small."""
    return F.broadcast(table) if len(table.limit(BROADCAST_SOURCES + 1).select(F.lit(1)).collect()) <= BROADCAST_SOURCES else table


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_REPEATS) -> DataFrame:
    """doc_id, size, source, source_size, target, repeats and taken = size * repeats.

    Null texts have size 0; a null source is a source of its own; rows with one doc_id
    share their hash and so their repeats. An empty table gives no rows. Source names
    are compared by code point; other columns are ignored.
    """
    slim = durable(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), hash60(F.col("doc_id")).alias("hash")), "slim")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = durable(source_targets(sizes, weights, cap), "targets")
    base = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(F.lit(0)).cast("long")
    budgets = durable(targets.withColumn("base", base).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")), "budgets")
    limits = _thresholds(slim, budgets).withColumnRenamed("source", "_l")
    per_source = _small(durable(budgets.select(F.col("source").alias("_b"), "source_size", "target").join(limits, _same("_b", "_l")).drop("_l"), "limits"))
    repeats = F.least(F.col("base") + (F.col("hash") < F.col("threshold")).cast("long"), F.lit(cap).cast("long"))
    out = slim.join(per_source, _same("source", "_b")).withColumn("repeats", repeats)
    return out.select("doc_id", "size", "source", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


ORACLE_SQL = f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ([1, 2, 3])[((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as w from s),
r as (select *, 3 * source_size as cap, 3 * source_size / w as ratio from w),
l as (select *, row_number() over (order by ratio, source is null, source) as i, ((sum(source_size) over () - coalesce(sum(cap) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)))::double as level
    from r window b as (order by ratio, source is null, source rows between unbounded preceding and 1 preceding)),
t as (select *, coalesce(least(cap::double, w * arg_min(level, i) filter (level <= ratio) over ()), 0) as target from l),
g as (select *, case when source_size > 0 then least(floor(target / source_size), 3)::bigint else 0 end as base from t),
c as (select d.*, g.source_size, g.target, g.base, g.target - g.base * g.source_size as rest,
    sum(size) over (partition by d.source order by h range between unbounded preceding and current row) as cum,
    sum(size) over (partition by d.source, h) as tie from d join g on d.source is not distinct from g.source)
select doc_id, size, source, source_size, target,
    least(base + case when rest > 0 and (cum <= rest or (cum - tie <= rest and cum - rest < rest - (cum - tie))) then 1 else 0 end, 3)::bigint as repeats,
    (size * least(base + case when rest > 0 and (cum <= rest or (cum - tie <= rest and cum - rest < rest - (cum - tie))) then 1 else 0 end, 3))::bigint as taken
from c
"""
