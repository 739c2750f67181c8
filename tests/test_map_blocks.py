"""Matching of all maps in blocks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom import catalog
from gridloom.operators import matching as T
from gridloom.operators import similarity as S
from gridloom.plans import matching as P


def _wafers(spark):
    draw = random.Random(4)
    cells = {(w, k): {draw.randrange(121) for _ in range(draw.randint(1, 30))} for w in range(25) for k in range(1, 5) if draw.random() < 0.7}
    cells[3, 2], cells[4, 2], cells[3, 4], cells[4, 4] = {7, 100}, {7, 100}, {1}, {1}  # equally alike in two classes
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = {}
    for (w, k), own in cells.items():
        rows.setdefault(w, []).append((k, [signed(sum(1 << (c - 64 * n) for c in own if c // 64 == n)) for n in (0, 1)]))
    return cells, spark.createDataFrame(list(rows.items()), "wafer_id long, classes array<struct<class:long,words:array<long>>>")


def test_best_class_overlap_by_hand(spark):
    cells, wafers = _wafers(spark)
    hand = {}
    for (q, k), a in sorted(cells.items()):
        for (c, x), b in cells.items():
            if q != c and k == x and a & b and len(a & b) / len(a | b) > hand.get((q, c), (0, 0.0))[1]:
                hand[q, c] = (k, len(a & b) / len(a | b))
    assert {(r.query_id, r.candidate_id): (r["class"], r.iou) for r in T.best_class_overlap(wafers).collect()} == hand


def test_every_wafer_asks_for_its_class_match(spark, sf):
    rows = catalog.queries()["j14_class_match"](spark, sf)
    wafers = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert rows.select("query_id").distinct().count() == wafers > 1


def _token_sides(spark, sf):
    t = P.tokens(spark, sf).localCheckpoint()
    return T.score_token_pairs(T.block_token_pairs(t, t), P.H, P.W).localCheckpoint(), T.token_lists(t).localCheckpoint()


def test_top_means_and_evidence_of_blocks(spark, sf):
    scored, t = _token_sides(spark, sf)
    plain = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    for k in (1, 2, 9):
        assert plain(T.block_top_mean(t, t, P.H, P.W, k)) == plain(T.top_mean_scores(scored, k))
    order = S.Window.partitionBy("query_id", "candidate_id", "q_token").orderBy(F.desc(F.round("score", 6)), "c_token")
    best = scored.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 2")
    assert plain(T.block_top_evidence(t, t, P.H, P.W, 2)) == plain(best.select("query_id", "candidate_id", "q_token", "c_token", F.round("score", 6), "place"))


@pytest.mark.parametrize("name", ["j11_top_mean", "j9_top_evidence", "j12_dense_scores", "p14_mutual_nearest"])
def test_every_map_asks(spark, sf, name):
    rows = catalog.queries()[name](spark, sf).select("query_id", "candidate_id").distinct().collect()
    maps = {r.candidate_id for r in rows}
    assert {r.query_id for r in rows} == maps and len(rows) == len(maps) * (len(maps) - 1) > 0


def test_token_scores_take_the_same_memory_again():
    draw = np.random.default_rng(3)
    entry = lambda: {"token": 1, **{x: float(draw.uniform(1, 9)) for x in T.SCORED}, "geometry": [float(x) for x in draw.random(10)]}
    side = lambda first: T.Tokens(pa.table({"map_id": range(first, first + 4), "tokens": [[entry() for _ in range(n)] for n in (3, 1, 4, 2)]}))
    q, c = side(0), side(10)
    whole = {k: v.copy() for k, v in T.token_scores(q, c, 16, 16).items()}
    first, again = T.token_scores(q.part(0, 2), c, 16, 16), T.token_scores(q.part(2, 4), c, 16, 16)
    assert all(np.shares_memory(first[k], again[k]) for k in whole) and all((again[k] == whole[k][4:]).all() for k in whole)


def test_label_sets_meet_in_large_blocks(spark, sf, monkeypatch):
    blocks, plain = [], S.block_grid
    monkeypatch.setattr(S, "block_grid", lambda q, c, key, block: blocks.append(block) or plain(q, c, key, block))
    assert catalog.queries()["p12_label_gated_score"](spark, sf).count()
    assert blocks == [S.SLIM_BLOCK] and min(S.SLIM_BLOCK) >= 2 * S.BLOCK


def test_blocks_of_token_pairs_are_small(spark, sf, monkeypatch):
    blocks, plain = [], S.block_grid
    monkeypatch.setattr(S, "block_grid", lambda q, c, key, block: blocks.append(block) or plain(q, c, key, block))
    for name in ("j1_token_pair_scores", "j1_zernike_pair_scores"):
        catalog.queries()[name](spark, sf)
    assert [a * b <= 1 << 17 for a, b in blocks] == [True, True]
