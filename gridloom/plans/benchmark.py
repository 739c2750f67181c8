"""Queries for the preference benchmark: maps whose id is divisible by 20 ask, all maps may be picked as negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import benchmark as B
from ..operators import transforms as X
from ..operators.sampling import numbered
from ..sources import scratch
from . import adapters as A
from .adapters import H, SQL_GRID, W

ASKS = "map_id % 20 = 0"


def _mixed(key: str, part: str, seed: int) -> str:
    return f"(((({key}) % 65536) * 4096 + ({part})) * 2654435761 + {seed * 40503}) % 4294967296"


def _drawn(name: str, eligible: str, share: str, seed: int) -> str:
    """CTE of the drawn cells: `share` of `eligible` rows of q, an expression over area."""
    return f"{name} as (select map_id, r, c from (select q.*, a.area, row_number() over (partition by q.map_id order by {_mixed('q.map_id', 'q.r * 16 + q.c', seed)}, q.r * 16 + q.c) as k from q join a using (map_id) where {eligible}) where k <= {share})"


_SHARE = "greatest(round_even({} * {}, 0), 1)"
_SET = "select v.map_id, v.kind, g.r, g.c, g.status"
SQL_VARIANTS = f"""{SQL_GRID}, q as (select * from grid where {ASKS}), a as (select map_id, count(*) filter (status = 2) as area from q group by 1), d as (select map_id, r, c from q where status = 2),
 {_drawn("n1", "status = 1", _SHARE.format("greatest(area, 1)", 0.03), 1)}, {_drawn("n2", "status = 1", _SHARE.format("greatest(area, 1)", 0.15), 2)},
 {_drawn("o1", "status = 2", _SHARE.format("area", 0.10), 3)}, {_drawn("o2", "status = 2", _SHARE.format("area", 0.45), 4)}, {_drawn("o3", "status = 2", _SHARE.format("area", 0.45), 6)}, {_drawn("mid", "status = 1", "1", 5)},
 reach(map_id, r, c, label) as (select map_id, r, c, r * 16 + c from d union select reach.map_id, b.r, b.c, reach.label from reach join d b on b.map_id = reach.map_id and abs(b.r - reach.r) <= 1 and abs(b.c - reach.c) <= 1),
 lab as (select map_id, r, c, min(label) as token from reach group by 1, 2, 3), big as (select map_id, arg_max(token, n * 1000 - token) as token from (select map_id, token, count(*) as n from lab group by 1, 2) group by 1),
 left_over as (select lab.map_id, lab.r, lab.c from lab join big using (map_id) where lab.token <> big.token),
 hit as (
 select map_id, 'identity' as kind, r, c from d union all select map_id, 'rot_90', 15 - c, r from d union all select map_id, 'rot_180', 15 - r, 15 - c from d
 union all select map_id, 'shift_mild', r + 1, c + 1 from d union all select map_id, 'shift_strong', r + 2, c + 1 from d
 union all select distinct map_id, 'scale_mild', cast(round_even((r - 8) * 1.1::double + 8, 0) as int), cast(round_even((c - 8) * 1.1::double + 8, 0) as int) from d
 union all (select map_id, 'noise_mild', r, c from d union select map_id, 'noise_mild', r, c from n1) union all (select map_id, 'noise_strong', r, c from d union select map_id, 'noise_strong', r, c from n2)
 union all (select map_id, 'dropout_mild', r, c from (select * from d except select * from o1)) union all (select map_id, 'dropout_strong', r, c from (select * from d except select * from o2))
 union all (select map_id, 'cluster_extra', r, c from d union select q.map_id, 'cluster_extra', q.r, q.c from q join mid m on m.map_id = q.map_id where (q.r - m.r) * (q.r - m.r) + (q.c - m.c) * (q.c - m.c) <= 4)
 union all select map_id, 'cluster_dropout', r, c from left_over
 union all select map_id, 'cluster_dropout', r, c from (select * from d except select * from o3) where map_id not in (select map_id from left_over)),
 kinds(k, kind, strength) as (values {", ".join(f"({k}, '{n}', '{s}')" for k, (n, s) in enumerate(B.VARIANTS))}),
 made as (select q.map_id, kinds.kind, kinds.strength, q.r, q.c, case when q.status = 0 then 0 when hit.map_id is not null then 2 else 1 end as status
 from q cross join kinds left join hit on hit.map_id = q.map_id and hit.kind = kinds.kind and hit.r = q.r and hit.c = q.c)"""


def asking(spark, sf_dir):
    return A.maps(spark, sf_dir).where(ASKS)


def _digits(status):
    return F.array_join(status, "")


@query("b9_variants", f"with recursive {SQL_VARIANTS} select map_id, kind as transform_type, strength as transform_strength, count(*) filter (status = 2) as area, string_agg(status, '' order by r, c) as cells from made group by 1, 2, 3")
def variants(spark, sf_dir):
    """All twelve variants of each asking map, as maps."""
    made = B.variant_maps(asking(spark, sf_dir), H, W)
    return made.select("map_id", "transform_type", "transform_strength", F.size(F.filter("status", lambda s: s == 2)).cast("bigint").alias("area"), _digits("status").alias("cells"))


SQL_OUTLINES = f"""{A.SQL_CELLS}, {A.SQL_LABELS}, ls as (select map_id, list(label) as labels from label_rows group by 1),
 outline as (select c.map_id, c.area, c.r, c.c, coalesce(ls.labels, []) as labels from (select map_id, count(*) as area, avg(r) as r, avg(c) as c from cells group by 1) c left join ls using (map_id))"""
_PAIRED = f"""{SQL_OUTLINES}, dist as (select q.map_id as query_id, c.map_id as candidate_id, len(list_intersect(q.labels, c.labels)) / cast(greatest(len(q.labels) + len(c.labels) - len(list_intersect(q.labels, c.labels)), 1) as double) as jac,
 abs(q.area - c.area) / cast(greatest(q.area, 1) as double) as area, sqrt((q.r - c.r) * (q.r - c.r) + (q.c - c.c) * (q.c - c.c)) as apart, {_mixed("q.map_id", "c.map_id", 7)} as h from outline q join outline c on q.map_id <> c.map_id where q.{ASKS})"""
_LISTS = f"""{_PAIRED}, crit as (select query_id, candidate_id, 'random' as criterion, cast(h as double) as key from dist where jac <= 0 union all select query_id, candidate_id, 'area', area from dist where jac <= 0 union all select query_id, candidate_id, 'position', apart from dist where jac <= 0
 union all select query_id, candidate_id, 'similar', area + apart from dist where jac <= 0 union all select query_id, candidate_id, 'hard', -(area + apart) from dist where jac >= 1 union all select query_id, candidate_id, 'any', h from dist),
 listed as (select query_id, criterion, candidate_id, row_number() over (partition by query_id, criterion order by round(key, 9), candidate_id) as rk from crit),
 held as (select query_id, {", ".join(f"coalesce(list(candidate_id order by rk) filter (criterion = '{c}'), []) as {c}_ids" for c in ("random", "area", "position", "similar", "hard", "any"))} from listed where rk <= 8 group by 1),
 picks(query_id, slot, taken) as (select query_id, 0, cast([] as bigint[]) from held union all
 select p.query_id, p.slot + 1, list_append(p.taken, list_filter(list_concat(list_concat(case p.slot {" ".join(f"when {k} then {B.CRITERION[n]}_ids" for k, n in enumerate(B.NEGATIVES))} end, random_ids), any_ids), lambda x: not list_contains(p.taken, x))[1]) from picks p join held using (query_id) where p.slot < 8),
 chosen as (select query_id, cast(slot - 1 as bigint) as slot, taken[slot] as candidate_id from picks where slot > 0 and taken[slot] is not null),
 slots(slot, negative_type) as (values {", ".join(f"({k}, '{n}')" for k, n in enumerate(B.NEGATIVES))}), neg as (select query_id, chosen.slot, negative_type, candidate_id from chosen join slots using (slot))"""


def outlines(spark, sf_dir):
    labels = A.label_rows(spark, sf_dir).groupBy("map_id").agg(F.collect_set("label").alias("labels"))
    return B.map_outlines(A.maps(spark, sf_dir), labels, H, W)


def negatives(spark, sf_dir):
    return B.pick_negatives(B.negative_lists(outlines(spark, sf_dir), ASKS))


@query("b7_negatives", f"with recursive {_LISTS} select query_id, slot, negative_type, candidate_id from neg")
def picked_negatives(spark, sf_dir):
    """Eight negatives of five kinds for each asking map, each pick but those before it."""
    return negatives(spark, sf_dir)


@query("o8_composite_extremes", f"""with {_PAIRED} select query_id, arg_min(candidate_id, {{'d': round(area + apart, 9), 'id': candidate_id}}) filter (jac <= 0) as nearest_other, arg_min(candidate_id, {{'d': -round(area + apart, 9), 'id': candidate_id}}) filter (jac >= 1) as farthest_same from dist group by 1""")
def composite_extremes(spark, sf_dir):
    """Of maps without a common label the nearest, of maps with the same labels the farthest, by area delta and centroid distance together."""
    firsts = B.negative_lists(outlines(spark, sf_dir), ASKS, 1)
    of = lambda criterion: F.max(F.when(F.col("criterion") == criterion, F.col("candidate_id")))
    return firsts.groupBy("query_id").agg(of("similar").alias("nearest_other"), of("hard").alias("farthest_same"))


_ROWS = f"""ordered as (select map_id, row_number() over (order by map_id) - 1 as query_order from (select distinct map_id from cells where {ASKS})),
 fixed(k, row_type, kind, strength) as (values (0, 'query', 'query', 'none'), {", ".join(f"({k}, 'synthetic', '{n}', '{s}')" for k, (n, s) in enumerate(B.VARIANTS, 1))}),
 rows_b as (select cast(query_order * 21 + k as bigint) as sample_id, query_order, cast(query_order * 21 as bigint) as query_id, map_id as source_id, row_type, kind, strength from ordered cross join fixed
 union all select cast(query_order * 21 + 13 + slot as bigint), query_order, cast(query_order * 21 as bigint), candidate_id, 'real_negative', negative_type, 'none' from neg join ordered on ordered.map_id = neg.query_id)"""


def bench_rows(spark, sf_dir):
    asks = A.cells(spark, sf_dir).where(ASKS).select("map_id").distinct()
    ordered = numbered(asks, ["map_id"], F.floor(F.col("map_id") / 4096), "place").select("map_id", (F.col("place") - 1).alias("query_order"))
    return scratch.written(B.benchmark_rows(ordered, negatives(spark, sf_dir)), "benchmark")


@query("b6_benchmark_rows", f"with recursive {_LISTS}, {_ROWS} select * from rows_b")
def benchmark_rows(spark, sf_dir):
    return bench_rows(spark, sf_dir)


@query("b8_preference_rules", f"""with recursive {_LISTS}, {_ROWS}, firsts as (select query_id, kind, min(sample_id) as sample_id from rows_b group by 1, 2), rules(a, b, rule_type, rule_group) as (values {", ".join(str(r) for r in B.RULES)})
 select x.query_id, x.sample_id as preferred_candidate_id, y.sample_id as less_preferred_candidate_id, rule_type, rule_group from rules join firsts x on x.kind = a join firsts y on y.kind = b and y.query_id = x.query_id""")
def preference_rules(spark, sf_dir):
    return B.benchmark_preferences(bench_rows(spark, sf_dir))


@query("b6_benchmark_maps", f"""with recursive {SQL_VARIANTS}, {_LISTS.replace(A.SQL_CELLS + ", ", "", 1)}, {_ROWS}, own as (select map_id, 'any' as kind, r, c, status from grid union all select map_id, kind, r, c, status from made)
 select sample_id, b.kind, source_id, count(*) filter (status = 2) as area, string_agg(status, '' order by r, c) as cells from rows_b b join own on own.map_id = b.source_id and own.kind = case when row_type = 'synthetic' then b.kind else 'any' end group by 1, 2, 3""")
def benchmark_maps(spark, sf_dir):
    """The map behind every sample of the benchmark."""
    made = B.benchmark_maps(bench_rows(spark, sf_dir), A.maps(spark, sf_dir), H, W)
    return made.select("sample_id", "kind", "source_id", F.size(F.filter("status", lambda s: s == 2)).cast("bigint").alias("area"), _digits("status").alias("cells"))


@query("b10_changed_copies")
def changed_copies(spark, sf_dir):
    """A copy of each asking map by each kind of change, drawn until it is different enough, as a map."""
    made = X.changed_copies(asking(spark, sf_dir), H, W)
    inside = F.transform(F.sequence(F.lit(0), F.lit(H * W - 1)), lambda i: F.array_contains("cells", i).cast("int"))
    return made.select("map_id", "wanted", "kind", "accepted", "dx", "dy", "angle", "scale", "dropout", "noise", F.size("cells").alias("area"), F.round("iou", 6).alias("iou"), _digits(inside).alias("cells"))
