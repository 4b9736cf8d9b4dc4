"""Secret scans with multipart credential linking. DataFrame functions only.

Patterns find parts: access identifiers, secrets and endpoints. Strong parts (the kinds
assign, access and hex) are findings by themselves. Weak ones, which alone would be
noise, are findings only if a complementary part lies in the same scope: an interval
join of the parts of a row, made as a sweep over their sorted places. Texts stay where
they are; only places are shuffled.

Positions are code points. A pattern's gaps and matches are extracted alternately, so
running sums of their lengths are the positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegap.llm.common import durable

SCOPE = 200


def _either_case(word: str) -> str:
    """ASCII letters of a word in either case, whatever the engine's case folding is."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN_HEAD = f"(?:{KEYS})[\"']?\\x20*[:=]\\x20*[\"']?"
#: kind: (pattern, least length of the match or of an assignment's value)
STRONG = {
    "assign": (ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]+", 6),
    "access": ("AKIA[A-Z0-9]+", 20),
    "hex": ("[0-9a-f]{24,}", 24),
}
#: Weak parts: temporary or role identifiers, key-shaped strings, endpoints.
WEAK = {
    "weak_id": ("(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}", 16),
    "weak_secret": ("[A-Za-z0-9+/]{40,}", 40),
    "endpoint": ("https?://[A-Za-z0-9._:/-]+", 10),
}
#: For a weak kind, the kinds of which one must lie within its scope.
NEEDS = {
    "weak_id": ("assign", "hex", "weak_secret"),
    "weak_secret": ("access", "weak_id"),
    "endpoint": ("access", "weak_id"),
}
#: Strings of which a text that holds the kind holds one (of assignments: in any case).
HINTS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("AKIA",), "weak_id": ("ASIA", "AROA", "AIDA"), "endpoint": ("://",)}


def _may_hold(text: Column, kind: str) -> Column:
    """A cheap test before the positions of a kind are looked for."""
    if kind not in HINTS:
        return text.rlike((STRONG | WEAK)[kind][0])
    seen = F.lower(text) if kind == "assign" else text
    hit = F.lit(False)
    for h in HINTS[kind]:
        hit = hit | F.contains(seen, F.lit(h))
    return hit


def _found(text: Column, kind: str, pattern: str, least: int) -> Column:
    """array<struct<gap, len, own>> of a kind's matches: characters since the last one, its
    length and the length that counts."""
    # \G: a search that fails at the text's tail is not begun anew at each place of it
    whole = F.lit(f"\\G(?s:(.*?))({pattern})")
    gaps, hits = F.regexp_extract_all(text, whole, F.lit(1)), F.regexp_extract_all(text, whole, F.lit(2))
    found = F.transform(
        F.arrays_zip(gaps.alias("g"), hits.alias("h")),
        lambda z: F.struct(F.length(z["g"]).alias("gap"), F.length(z["h"]).alias("len"), _value_length(z["h"], kind).alias("own")),
    )
    return F.when(_may_hold(text, kind), found).otherwise(F.array().cast("array<struct<gap:int,len:int,own:int>>"))


def _value_length(hit: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(hit, "^" + ASSIGN_HEAD, "")) if kind == "assign" else F.length(hit)


def _parts(found: DataFrame) -> DataFrame:
    """rid, kind (its number), start and end of the parts that are long enough. A part's
    place is the running sum of gaps and lengths up to it, among its kind in its row."""
    kinds = list(STRONG | WEAK)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("found")) for i, k in enumerate(kinds)])).alias("x")
    rows = found.select("rid", each).select("rid", F.col("x.kind").alias("kind"), F.posexplode("x.found").alias("at", "f"))
    run = Window.partitionBy("rid", "kind").orderBy("at")
    rows = rows.select("rid", "kind", F.sum(F.col("f.gap") + F.col("f.len")).over(run).alias("end"), F.col("f.len").alias("len"), F.col("f.own").alias("own"))
    least = F.element_at(F.array(*[F.lit(n) for _, n in (STRONG | WEAK).values()]), F.col("kind") + 1)
    return rows.where(F.col("own") >= least).select("rid", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def _reached(parts: DataFrame, needs: dict[int, tuple[int, ...]], before: int, scope: int) -> DataFrame:
    """Parts with ``hit``: whether a part of a kind that its kind needs ends at or after its
    start less ``scope`` (less ``before``) and starts at or before its end plus ``scope``.

    The interval join is a sweep, not a comparison of all parts of a row with each other:
    each part is at its own end as a partner and at its start as a seeker. From the right
    to the left, the smallest start among the partners passed so far decides.
    """
    smallest = F.lit(None).cast("long")
    role = F.explode(F.array(F.lit(0), F.lit(1))).alias("seeks")  # partners come first where both lie at one place
    at = F.when(F.col("seeks") == 1, F.col("start") - scope + before).otherwise(F.col("end"))
    rows = parts.select("rid", "kind", "start", "end", role).withColumn("at", at)
    sweep = Window.partitionBy("rid").orderBy(F.desc("at"), "seeks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for wanted in sorted(set(needs.values())):
        passed = F.min(F.when((F.col("seeks") == 0) & F.col("kind").isin(*wanted), F.col("start"))).over(sweep)
        smallest = F.when(F.col("kind").isin(*[k for k, w in needs.items() if w == wanted]), passed).otherwise(smallest)
    rows = rows.withColumn("least", smallest).where("seeks = 1")
    hit = F.coalesce(F.col("least") <= F.col("end") + scope - before, F.lit(False))
    return rows.select("rid", "kind", "start", "end", hit.alias("hit"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row.

    ``spans`` holds all strong spans and the linked weak ones, ties in the order of kinds.
    Null and empty texts have none. Rows are independent: repeated rows give repeated
    results, other columns are ignored, an empty table gives none. Weak spans that overlap a
    strong one or lack a complement within ``scope`` code points are left out; a part that
    begins just ``scope`` after another's end is within. Texts of any length are searched
    whole; only the places of parts are shuffled, by row, and a row's parts are sorted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = list(STRONG | WEAK)
    n_strong = len(STRONG)
    found = docs.select("doc_id", *[_found(text, k, *p).alias(k) for k, p in (STRONG | WEAK).items()])
    found = durable(found.withColumn("rid", F.monotonically_increasing_id()), "found")
    parts = durable(_parts(found), "parts")
    weak = {i: tuple(range(n_strong)) for i in range(n_strong, len(kinds))}
    free = _reached(parts, weak, 1, 0).where((F.col("kind") < n_strong) | ~F.col("hit")).drop("hit")
    needs = {kinds.index(k): tuple(kinds.index(o) for o in v) for k, v in NEEDS.items()}
    linked = _reached(free, needs, 0, scope).where((F.col("kind") < n_strong) | F.col("hit"))
    name = F.element_at(F.array(*map(F.lit, kinds)), F.col("kind") + 1)
    span = F.struct(F.col("start").alias("s"), F.col("kind").alias("k"), F.concat_ws(":", name, "start", "end").alias("t"))
    ends = linked.groupBy("rid").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(STRONG)],
        F.array_sort(F.collect_list(span)).alias("all"),
    )
    base = F.filter("all", lambda x: x["k"] < n_strong)
    joined = [F.coalesce(F.array_join(F.transform(c, lambda x: x["t"]), ","), F.lit("")) for c in (base, F.col("all"))]
    out = found.select("doc_id", "rid").join(durable(ends, "spans"), "rid", "left")
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in STRONG],
        F.sha2(joined[0].cast("binary"), 256).alias("base_sha256"),
        joined[1].alias("spans"),
    )


def _sql_found(kind: str, pattern: str, least: int) -> str:
    p = pattern.replace("'", "''")
    own = f"length(regexp_replace(h[i], '^{ASSIGN_HEAD.replace(chr(39), chr(39) * 2)}', ''))" if kind == "assign" else "length(h[i])"
    return f"""select doc_id, rid, '{kind}' as kind, s, s + length(h[i]) as e from (
      select doc_id, rid, h, i, (list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[:i-1], lambda x: length(x))), 0))::bigint as s
      from (select doc_id, rid, g, h, unnest(range(1, len(h) + 1)) as i from (
        select doc_id, rid, regexp_extract_all(t, '(?s)(.*?)({p})', 1) as g, regexp_extract_all(t, '(?s)(.*?)({p})', 2) as h from d))) where {own} >= {least}"""


def _oracle() -> str:
    kinds = list(STRONG | WEAK)
    parts = " union all ".join(_sql_found(k, *(STRONG | WEAK)[k]) for k in kinds)
    strong = ", ".join(f"'{k}'" for k in STRONG)
    order = " ".join(f"when '{k}' then {i}" for i, k in enumerate(kinds))
    needs = " or ".join(f"(x.kind = '{k}' and y.kind in ({', '.join(repr(o) for o in v)}))" for k, v in NEEDS.items())
    join = "string_agg(kind || ':' || s || ':' || e, ',' order by s, case kind {} end)".format(order)
    return f"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as rid from documents), p as ({parts}),
f as (select * from p where kind in ({strong}) or not exists (select 1 from p o where o.rid = p.rid and o.kind in ({strong}) and o.s < p.e and o.e > p.s)),
k as (select * from f x where kind in ({strong}) or exists (select 1 from f y where y.rid = x.rid and ({needs}) and y.s <= x.e + {SCOPE} and y.e >= x.s - {SCOPE})),
a as (select rid, {join} as spans, coalesce({join} filter (kind in ({strong})), '') as base,
  count(*) filter (kind = 'assign') as n1, count(*) filter (kind = 'access') as n2, count(*) filter (kind = 'hex') as n3 from k group by rid)
select d.doc_id, coalesce(n1, 0) as n_assign, coalesce(n2, 0) as n_access, coalesce(n3, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (rid)
"""


ORACLE_SQL = _oracle()
