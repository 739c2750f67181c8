"""Whole ranked lists without a shuffle of pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import catalog
from gridloom.operators import metrics as M
from gridloom.operators import similarity as S
from gridloom.plans import metrics as P
from gridloom.plans import rankings as Q
from gridloom.sources import tables

from .test_blocks import _lists, _vectors

ROWS = "query_id long, candidate_id long, score double, rk long"


def _found(df):
    found = {}
    for r in df.orderBy("query_id", "rk").collect():
        found.setdefault(r.query_id, []).append((r.candidate_id, r.score))
        assert r.rk == len(found[r.query_id])
    return found


def test_whole_lists_by_hand(spark, monkeypatch):
    monkeypatch.setattr(S, "LIST_SCORES", 100)
    rows, v = _vectors(spark)
    v = v.select("id", "v")
    assert _found(S.whole_lists(v.where("id % 10 = 0"), v, "id", "v", S.list_rows, ROWS)) == _lists(rows)
    allowed = lambda q, c: (q + c) % 3 == 0
    assert _found(S.whole_lists(v.where("id % 10 = 0"), v, "id", "v", S.list_rows, ROWS, only=allowed)) == _lists(rows, allowed)
    text = {q: sorted(x, key=lambda y: (y[1] is None, -(y[1] or 0), str(y[0]))) for q, x in _lists(rows).items()}
    assert _found(S.whole_lists(v.where("id % 10 = 0"), v, "id", "v", S.list_rows, ROWS, as_text=True)) == text


def test_whole_lists_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    v = spark.createDataFrame([(0, [1.0, 1.0]), (1, [inf, 0.0]), (2, [nan, 0.0]), (3, [-inf, 0.0]), (4, None), (5, [2.0, 0.0]), (6, [1e9, 0.0])], "id long, v array<double>")
    assert [x for x, _ in _found(S.whole_lists(v.where("id = 0"), v, "id", "v", S.list_rows, ROWS))[0]] == [2, 1, 6, 5, 3, 4]
    assert [x for x, _ in _found(S.whole_lists(v.where("id = 4"), v, "id", "v", S.list_rows, ROWS))[4]] == [0, 1, 2, 3, 5, 6]
    assert S.whole_lists(v.where("id > 9"), v, "id", "v", S.list_rows, ROWS).count() == 0


def test_metrics_of_one_list(spark):
    draw = random.Random(2)
    lists = {q: [draw.choice([0.0, 0.0, 1 / 3, 0.5, 1.0]) for _ in range(draw.randint(1, 40))] for q in range(12)} | {12: [0.0, 0.0]}
    rows = spark.createDataFrame([(q, k + 1, x) for q, own in lists.items() for k, x in enumerate(own)], "query_id long, rk long, jac double")
    rows = rows.withColumn("hit", (F.col("jac") > 0).cast("double")).withColumn("exact", (F.col("jac") == 1).cast("double")).withColumn("gain", F.col("jac"))
    for r in M.query_metrics(rows, rows, (1, 5, 10)).collect():
        mine = {n: x.to_pylist()[0] for n, x in M.list_metrics(r.query_id, np.array(lists[r.query_id]), (1, 5, 10)).items()}
        assert set(mine) == set(r.asDict()) and all(abs(mine[n] - x) < 1e-12 if x is not None else mine[n] is None for n, x in r.asDict().items())


def test_flat_metrics_are_those_of_whole_lists(spark, sf):
    whole = Q.graded(spark, sf)
    means = M.mean_all(M.query_metrics(whole, whole, P.KS), *P.NAMES).first().asDict()
    own = {r.metric: r.value for r in catalog.queries()["k3_flat_metrics"](spark, sf).collect()}
    assert set(own) == set(means) and all(abs(own[n] - means[n]) < 1e-6 for n in means)


@pytest.mark.parametrize("name", ["o2_rank_by_score", "o3_rank_by_text_id", "f11_restrict_pairs", "p16_cross_modal", "m9_all_records_suite", "m15_rank_cdf"])
def test_lists_are_made_where_they_are_scored(spark, sf, monkeypatch, name):
    monkeypatch.setattr(S, "vector_pairs", None)
    monkeypatch.setattr(S, "blocked_pairs", None)
    assert catalog.queries()[name](spark, sf).count()


def test_lines_of_a_pair_stand_together(spark, sf):
    lines = spark.sql("select array(named_struct('seq', 3, 'score', -1.0d), named_struct('seq', 4, 'score', null), named_struct('seq', 1, 'score', 2.0d)) as lines")
    assert lines.select(tables.last_line(F.col("lines"), "score")).first()[0] is None
    assert "HashAggregate" not in catalog.queries()["s9_last_scores"](spark, sf)._jdf.queryExecution().executedPlan().toString()
