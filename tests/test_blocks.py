"""The steps of the third round's findings: blocks of pairs, best candidates, pools of label sets."""

import random

import numpy as np

from pyspark.sql import functions as F

from gridloom.functions import grid as G
from gridloom.operators import matching as T
from gridloom.operators import metrics as M
from gridloom.operators import ranking as K
from gridloom.operators import raster as R
from gridloom.operators import similarity as S


def _vectors(spark):
    """Small whole numbers, so that many scores are equal; one vector is null, one too short."""
    draw = random.Random(3)
    rows = [(k, [float(draw.randint(0, 2)) for _ in range(3)], [k % 3] if k % 4 else [k % 3, 5]) for k in range(60)]
    rows[7], rows[9] = (7, None, [1]), (9, [1.0, 2.0], [0])
    return rows, spark.createDataFrame(rows, "id long, v array<double>, labels array<long>")


def _lists(rows, allowed=lambda q, c: True):
    def score(a, b):
        return None if a is None or b is None or len(a) != 3 or len(b) != 3 else sum(x * y for x, y in zip(a, b))

    lists = {}
    for q, a, _ in rows:
        if q % 10 == 0:
            own = [(c, score(a, b)) for c, b, _ in rows if c != q and allowed(q, c)]
            lists[q] = sorted(own, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    return lists


def test_vector_pairs_best_and_all(spark):
    rows, v = _vectors(spark)
    for k in (4, None):
        own = K.by_score(S.vector_pairs(v.where("id % 10 = 0"), v, "id", "v", k))
        found = {}
        for r in own.orderBy("query_id", "rk").collect():
            found.setdefault(r.query_id, []).append((r.candidate_id, r.score))
        assert {q: x[:k] for q, x in found.items()} == {q: x[:k] for q, x in _lists(rows).items()}


def test_pairs_off_the_list_do_not_leave_a_block(spark):
    rows, v = _vectors(spark)
    allowed = lambda q, c: (q + c) % 3 == 0
    for k in (4, None):
        own, found = K.by_score(S.vector_pairs(v.where("id % 10 = 0"), v, "id", "v", k, only=allowed)), {}
        for r in own.orderBy("query_id", "rk").collect():
            found.setdefault(r.query_id, []).append((r.candidate_id, r.score))
        assert {q: x[:k] for q, x in found.items()} == {q: x[:k] for q, x in _lists(rows, allowed).items()}
        assert all(allowed(q, c) for q, x in found.items() for c, _ in x)


def test_a_block_gives_no_more_than_k_of_equal_scores(spark):
    v = spark.range(500).select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("v"))
    counts = S.vector_pairs(v.where("id = 20"), v, "id", "v", 5).groupBy("query_id").count().collect()
    _, across = S.block_grid(v.where("id = 20"), v, "id", S.VECTOR_BLOCK)
    assert counts[0]["count"] <= 5 * across.select("_across").distinct().count()


def test_vector_ends(spark):
    rows, v = _vectors(spark)
    ends = S.vector_ends(v.where("id % 10 = 0"), v.withColumn("kind", F.to_json("labels")), "id", "v", "kind").where("kind = '[2]'")
    key = lambda e: F.struct(F.col(f"{e}_score").isNull(), -F.col(f"{e}_score"), F.col(f"{e}_id").alias("id"))
    own = {r.query_id: (r.a, r.b) for r in ends.groupBy("query_id").agg(F.min(key("first"))["id"].alias("a"), F.max(key("last"))["id"].alias("b")).collect()}
    kind = {k for k, _, labels in rows if labels == [2]}
    assert own == {q: (x[0][0], x[-1][0]) for q, x in _lists(rows, lambda q, c: c in kind).items()}


def test_label_pools_count_what_pairs_show(spark):
    _, v = _vectors(spark)
    labels = v.select("id", "labels")
    asks = labels.where("id % 10 = 0")
    pairs = K.with_relevance(asks.select(F.col("id").alias("query_id")).crossJoin(labels.select(F.col("id").alias("candidate_id"))).where("query_id <> candidate_id"), labels)
    ranked = K.by_score(pairs.withColumn("score", (F.col("candidate_id") * 7 % 11).cast("double"))).where("rk <= 10")
    a, b = (sorted(M.query_metrics(ranked, pool, (1, 5)).collect()) for pool in (pairs, K.label_pools(asks, labels)))
    assert len(a) == len(b) == 6 and all(abs(x - y) < 1e-9 for r, s in zip(a, b) for x, y in zip(r, s))


def test_blocked_pairs_are_not_broadcast(spark):
    """Copies of a small side are many: Spark must not take them for small and send them to the driver."""
    own = spark.range(200).select("id", (F.col("id") % 3).alias("kind"))
    pairs = S.blocked_pairs(own.where("id % 20 = 0"), own, "id", also=("kind",))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and pairs.where("q_kind <> c_kind").count() == 0
    assert pairs.count() == sum(1 for q in range(0, 200, 20) for c in range(200) if q != c and q % 3 == c % 3)


def test_best_of_blocks_ties_and_self(spark):
    """Keys with many ties: the first of all are those of a plain sort, the query itself is never one of them."""
    own = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("x"))

    def orders(left, right):
        a, b = S.column_matrix(left, "x"), S.column_matrix(right, "x")
        return {"near": abs(a[:, None] - b[None, :])}

    best = S.ranked_best(S.best_of_blocks(own.where("id % 50 = 0"), own, "id", 6, orders), 6)
    found = {(r.query_id, r.rank): r.candidate_id for r in best.collect()}
    for q in range(0, 300, 50):
        assert [found[q, k] for k in range(1, 7)] == sorted((c for c in range(300) if c != q), key=lambda c: (abs(q % 7 - c % 7), c))[:6]


def test_token_pairs_meet_in_blocks(spark):
    """The same pairs as by joins on map ids, and after the sides are dealt out no exchange is left."""
    from gridloom.operators import matching as M

    tokens = spark.range(120).select((F.col("id") % 40).alias("map_id"), F.col("id").alias("token"))
    ids = tokens.select("map_id").distinct()
    asks = tokens.where("map_id % 20 = 0")
    maps = asks.select(F.col("map_id").alias("query_id")).distinct().crossJoin(ids.select(F.col("map_id").alias("candidate_id"))).where("query_id <> candidate_id")
    take = ("query_id", "candidate_id", "q_token", "c_token")
    own = M.block_token_pairs(asks, tokens)
    assert sorted(own.select(*take).collect()) == sorted(M.token_pairs(tokens, tokens, maps).select(*take).collect())
    assert own._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2


def test_hashed_shares_of_large_keys(spark):
    """The stated arithmetic, past the keys whose product leaves a long."""
    keys = [0, 7, 999, 53_000, 60_000, 5_999_999, 2**40 + 3, 2**62 + 12345]
    own = spark.createDataFrame([(k, c) for k in keys for c in (0, 17, 255)], "k long, c long").select("k", "c", G.hashed_share(F.col("k"), F.col("c"), 5).alias("x"))
    assert all(r.x == ((r.k * 65536 + r.c) * 2654435761 + 5) % 2**32 / 2**32 for r in own.collect())


def test_token_blocks_give_what_the_rows_give(spark):
    """Maps 0 to 39 of up to six tokens, some without any: scores, greedy matches and map scores of blocks against those of joined rows; no row for a pair is joined or shuffled."""
    draw = random.Random(5)
    fields = ["area", "lambda_1", "lambda_2", "centroid_r", "centroid_c", "radial", "max_run", "coverage"]
    rows = [(m, t, draw.randint(3, 9), *(draw.choice([0.5, 1.0, 4.0, 9.0]) for _ in range(2)), *(draw.uniform(0, 16) for _ in range(2)), draw.choice([0.3, 0.7, 0.9]), draw.choice([0.1, 0.3, 0.6]), 0.5, [draw.choice([0.0, 0.5, 1.0]) for _ in range(3)], [draw.uniform(0, 1) for _ in range(2)]) for m in range(40) for t in range(1, 1 + m % 7)]
    t = spark.createDataFrame(rows, ["map_id", "token", *fields, "geometry", "moments"]).withColumn("token", F.col("token").cast("int")).localCheckpoint()
    maps = spark.range(40).select(F.col("id").alias("map_id"))
    asks = F.col("map_id") % 7 < 3
    plain = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    pairs = maps.where(asks).select(F.col("map_id").alias("query_id")).crossJoin(maps.select(F.col("map_id").alias("candidate_id"))).where("query_id <> candidate_id")
    for moments in (False, True):
        scored = T.score_token_pairs(T.token_pairs(t.where(asks), t, pairs), 16, 16, moments)
        names = ["query_id", "candidate_id", "q_token", "c_token", "shape_sim", "position_affinity", "scale_affinity", "score"]
        lists = T.token_lists(t, maps).localCheckpoint()
        sides = lists.where(asks), lists
        assert plain(T.block_pair_scores(*sides, 16, 16, moments).select(names)) == plain(scored.select(names))
        matches = T.greedy_matches(scored).localCheckpoint()
        assert plain(T.block_matches(*sides, 16, 16, moments)) == plain(matches)
        own = T.map_scores(pairs, t, matches)
        assert plain(T.block_map_scores(*sides, 16, 16, moments)) == plain(own)
        best = S.top_k(T.block_map_scores(*sides, 16, 16, moments, k=4), "query_id", "candidate_id", 4)
        assert plain(best.select("query_id", "rank", "candidate_id")) == plain(S.top_k(own, "query_id", "candidate_id", 4).select("query_id", "rank", "candidate_id"))
    assert "Join" not in T.block_map_scores(*sides, 16, 16)._jdf.queryExecution().executedPlan().toString()


def test_bounds_are_dealt_by_counted_rows(spark, monkeypatch):
    """As many partitions as the rows ask for, each group whole in one; a group without key is left out."""
    monkeypatch.setattr(R, "TASK_ROWS", 10)
    rows = spark.createDataFrame([(k % 20 if k else None, k) for k in range(400)], "w long, x long")
    own = R.with_bounds(rows, ["w"], low=F.min("x"), high=F.max("x"))
    assert own.rdd.getNumPartitions() == 40
    found = own.withColumn("p", F.spark_partition_id()).groupBy("w").agg(F.countDistinct("p").alias("p"), F.count("*").alias("n"), F.max("low").alias("low"), F.max("high").alias("high")).collect()
    assert sorted((r.w, r.p, r.n, r.low, r.high) for r in found) == [(w, 1, 20 - (w == 0), w or 20, 380 + w) for w in range(20)]


def test_chamfer_and_shifts_of_blocks(spark):
    """Maps of 9 x 9 cells with two inspected areas and one empty map: block scores against those of each pair; no pair is joined."""
    draw = random.Random(9)
    rows = [(m, [int(m != 3 and draw.random() < 0.2) for _ in range(81)], [0 if m % 3 == 0 and k < 20 else 1 for k in range(81)]) for m in range(12)]
    maps = S.with_moves(S.with_distances(spark.createDataFrame(rows, "map_id long, mask array<int>, status array<int>"), 9, 9), 9, 9, 1).localCheckpoint()
    asks = F.col("map_id") % 4 < 2
    pairs = S.blocked_pairs(maps.where(asks), maps, "map_id").select(F.col("q_map_id").alias("query_id"), F.col("c_map_id").alias("candidate_id"), F.round(S.chamfer(9, 9), 6).alias("score"), S.shifted_overlap(9, 9, 1).alias("x"))
    plain = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())
    own = S.block_chamfer(maps.where(asks), maps, 9, 9)
    assert plain(own) == plain(pairs.select("query_id", "candidate_id", "score")) and "Join" not in own._jdf.queryExecution().executedPlan().toString()
    assert plain(S.block_shift_search(maps.where(asks), maps, 9, 9, 1)) == plain(pairs.select("query_id", "candidate_id", "x.score", "x.dr", "x.dc"))


def _by_hand(values, k):
    """The k best of each row by value rounded half up at six places, ties to the left."""
    rounded = S.half_up(values, 6)
    return [sorted((c for c in range(values.shape[1]) if values[r, c] > -np.inf), key=lambda c: (-rounded[r, c], c))[:k] for r in range(len(values))]


def test_best_of_scores_that_differ_past_the_sixth_place():
    draw = np.random.default_rng(5)
    values = draw.integers(-40, 40, (30, 900)) / 16 + draw.integers(-4, 5, (30, 900)) * 2e-7
    values[3], values[4, :890], values[5] = 0.25, -np.inf, -np.inf  # all equal, few, none
    for k in (1, 5, 20):
        i, j = S.first_k_rounded(values, k, 6)
        assert [[int(c) for c in sorted(j[i == r], key=_by_hand(values, k)[r].index)] for r in range(30)] == _by_hand(values, k)
    some, best = S.leftmost_best(values, 6)
    assert [(int(a), int(b)) for a, b in zip(some, best)] == [(r, x[0]) for r, x in enumerate(_by_hand(values, 1)) if x]


def test_scores_are_rounded_only_near_the_best(monkeypatch):
    seen, rounded = [], S.half_up
    monkeypatch.setattr(S, "half_up", lambda v, places: seen.append(v.size) or rounded(v, places))
    values = np.random.default_rng(7).normal(size=(50, 8000))
    S.first_k_rounded(values, 10, 6)
    S.leftmost_best(values, 6)
    assert sum(seen) < values.size / 50


def test_ends_of_vectors_that_are_not_finite(spark):
    inf, nan = float("inf"), float("nan")
    v = spark.createDataFrame([(0, [1.0, 1.0]), (1, [inf, 0.0]), (2, [nan, 0.0]), (3, [-inf, 0.0]), (4, None), (5, [2.0, 0.0])], "id long, v array<double>").withColumn("kind", F.lit("a"))
    rows = S.vector_ends(v.where("id = 0"), v, "id", "v", "kind").collect()
    assert 2 in {r.first_id for r in rows} and 4 in {r.last_id for r in rows}
    best = K.by_score(S.vector_pairs(v.where("id = 0"), v.drop("kind"), "id", "v", 5)).orderBy("rk").collect()
    assert [r.candidate_id for r in best] == [2, 1, 5, 3, 4]


def test_a_block_without_queries_gives_nothing(spark):
    i, j = S.first_k_rounded(np.zeros((0, 900)), 5, 6)
    assert len(i) == len(j) == 0
    v = spark.range(1200).select("id", F.array(F.col("id") * 1.0, F.lit(1.0)).alias("v"))
    rows = K.by_score(S.vector_pairs(v.where("id < 3"), v, "id", "v", 2)).where("rk = 1").collect()  # three queries, dealt to three blocks down
    assert {(r.query_id, r.candidate_id) for r in rows} == {(0, 1), (1, 1199), (2, 1199)}
