"""Small cases worked out by hand or by a plain loop."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import schemas
from gridloom.functions import grid as G
from gridloom.functions import segment as S
from gridloom.functions.moments import zernike
from gridloom.operators import matching, metrics, ranking, sampling
from gridloom.operators import raster as R
from gridloom.operators import segment as T
from gridloom.sources import arrays, images, klarf, settings, tables
from gridloom.sources.scratch import scratch_path


def one(spark, column, **arrays_):
    row = spark.createDataFrame([tuple(arrays_.values())], list(arrays_))
    return row.select(column.alias("x")).first()["x"]


def regions(mask: list[int], h: int, w: int, offsets) -> list[int]:
    out = [0] * (h * w)
    for i in range(h * w):
        if mask[i] and not out[i]:
            stack = [i]
            out[i] = i + 1
            while stack:
                r, c = divmod(stack.pop(), w)
                for dr, dc in offsets:
                    rr, cc = r + dr, c + dc
                    if 0 <= rr < h and 0 <= cc < w and mask[rr * w + cc] and not out[rr * w + cc]:
                        out[rr * w + cc] = i + 1
                        stack.append(rr * w + cc)
    return out


@pytest.mark.parametrize("offsets", [G.NEIGHBOURS_4, G.NEIGHBOURS_8])
def test_components_against_a_flood_fill(spark, offsets):
    r = random.Random(3)
    snake = [1 if (k // 9) % 2 == 0 or k % 9 == (8 if (k // 9) % 4 == 1 else 0) else 0 for k in range(81)]
    masks = [[int(r.random() < d) for _ in range(81)] for d in (0.2, 0.4, 0.6, 1.0, 0.0)] + [snake]
    table = spark.createDataFrame([(k, m) for k, m in enumerate(masks)], "k int, mask array<int>")
    for row in S.with_components(table, "labels", "mask", 9, 9, offsets).collect():
        assert row.labels == regions(masks[row.k], 9, 9, offsets)


def test_runs_on_a_circle(spark):
    bits = [True, True, False, False, False, True, False, True]
    assert one(spark, S.longest_run(F.col("b")), b=bits) == 3
    assert one(spark, S.longest_run(F.transform("b", lambda x: ~x)), b=bits) == 3
    assert one(spark, S.longest_run(F.col("b")), b=[True] * 8) == 8
    assert one(spark, S.bridged(F.col("b"), 1), b=bits) == [True, True, False, False, False, True, True, True]


def test_closing_fills_a_gap_but_not_the_outside(spark):
    mask = [0] * 25
    for i in (11, 13):
        mask[i] = 1
    valid = [1] * 25
    assert one(spark, G.close_within(F.col("m"), F.col("v"), 5, 5), m=mask, v=valid)[12] == 1
    valid[12] = 0
    assert one(spark, G.close_within(F.col("m"), F.col("v"), 5, 5), m=mask, v=valid)[12] == 0


def test_moves_and_sizes(spark):
    grid = list(range(9))
    assert one(spark, G.transform_cells(F.col("g"), 3, 3, "rot90"), g=grid) == np.rot90(np.arange(9).reshape(3, 3)).ravel().tolist()
    assert one(spark, G.transform_cells(F.col("g"), 3, 3, "shift:1:0"), g=grid) == [0, 0, 0, 0, 1, 2, 3, 4, 5]
    assert one(spark, G.fit(F.col("g"), 3, 3, 5, 5), g=grid)[6:9] == [0, 1, 2]
    assert one(spark, G.pool(F.col("g"), 3, 3, 2, "mean"), g=grid) == [2.0, 3.5, 6.5, 8.0]
    with pytest.raises(ValueError):
        G.pool(F.col("g"), 3, 3, 2, "median")


def test_densities_and_blur(spark):
    assert one(spark, G.density(F.col("g")), g=[0, 0, 0, 0]) == [0.0] * 4
    flat = one(spark, G.blur(F.col("g"), 4, 4), g=[1.0] * 16)
    assert flat == pytest.approx([1.0] * 16)
    assert one(spark, G.blur(F.col("g"), 4, 4, edge=False), g=[1.0] * 16)[0] < 1


def test_die_cells(spark):
    rows = spark.createDataFrame([("w", 0.0, 0.0), ("w", 10.0, 10.0), ("w", None, 1.0), ("v", 3.0, 3.0)], "wafer string, x double, y double")
    out = {(r.wafer, r.r, r.c) for r in R.map_by_range(rows, "wafer", "x", "y", 5, 5).collect()}
    assert out == {("w", 4, 0), ("w", 0, 4), ("v", 4, 0)}
    texts = spark.createDataFrame([("p",), (" OK ",), ("x",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(R.pass_fail(F.col("t"))).collect()] == [1, 1, 2, 0, 0]


def test_adaptive_settings():
    assert T.adaptive(12, 12, 144) == (2, 4)
    assert T.adaptive(12, 12, 144, 20, 10) == (20, 10)
    assert T.adaptive(52, 52, 2100) == (5, 6)


def ring_map(spark, cells, h=25, w=25):
    counts = [0] * (h * w)
    for r, c in cells:
        counts[r * w + c] = 1
    valid = [int((r - 12) ** 2 + (c - 12) ** 2 <= 132.25) for r in range(h) for c in range(w)]
    row = (1, counts, valid, [2 * int(n > 0) if n else v for n, v in zip(counts, valid)], [int(n > 0) for n in counts])
    return spark.createDataFrame([row], "map_id long, counts array<int>, valid array<int>, status array<int>, mask array<int>")


def test_a_ring_is_one_edge_token(spark):
    ring = {(round(12 + 10 * math.sin(a * math.pi / 45)), round(12 + 10 * math.cos(a * math.pi / 45))) for a in range(90)}
    blob = {(r, c) for r in range(11, 14) for c in range(11, 14)}
    out = T.arc_ring_residual_tokens(ring_map(spark, ring | blob), 25, 25, 437).collect()
    kinds = {r.kind: r for r in out}
    assert kinds["edge_ring"].area >= 0.9 * len(ring) and kinds["edge_ring"].coverage > 0.75  # 64 cells cannot fill 72 bins
    assert any(r.area == 9 and r.kind in ("blob", "central") for r in out)


def test_sparse_points_make_tokens_only_with_enough_evidence(spark):
    line = [(5, 5), (7, 7), (9, 9), (11, 11), (13, 13)]
    assert T.sparse_density_tokens(ring_map(spark, line), 25, 25).count() >= 1
    assert T.sparse_density_tokens(ring_map(spark, [(5, 5), (19, 19)]), 25, 25).count() == 0


def test_moments_do_not_change_with_a_turn():
    shape = np.array([(0, 0), (0, 1), (0, 2), (1, 0), (2, 0), (3, 0), (3, 1)])
    turned = np.array([(c, -r) for r, c in shape])
    a, b = zernike(shape[:, 0].astype(float), shape[:, 1].astype(float)), zernike(turned[:, 0].astype(float), turned[:, 1].astype(float))
    assert len(a) == 24 and np.allclose(a, b, atol=0.02) and np.linalg.norm(a) == pytest.approx(1.0)


def test_scale_gate(spark):
    columns = "map_id long, token int, area long, centroid_r double, centroid_c double, lambda_1 double, lambda_2 double, radial double, coverage double, max_run double, geometry array<double>"
    t = spark.createDataFrame([(1, 1, 9, 5.0, 5.0, 1.0, 1.0, 0.1, 0.0, 0.0, [0.5] * 3), (2, 1, 49, 5.0, 5.0, 16.0, 16.0, 0.1, 0.0, 0.0, [0.5] * 3)], columns)
    pairs = spark.createDataFrame([(1, 2)], "query_id long, candidate_id long")
    both = matching.token_pairs(t, t, pairs)
    assert matching.score_token_pairs(both, 10, 10, p={**matching.DEFAULTS, "scale_ratio_min": 0.35}).first().score == 0
    assert matching.score_token_pairs(both, 10, 10, p={**matching.DEFAULTS, "scale_ratio_min": 0.0}).first().score > 0.8


def test_greedy_takes_the_best_pair_first(spark):
    rows = [(1, 2, 1, 1, 0.9), (1, 2, 1, 2, 0.8), (1, 2, 2, 1, 0.85), (1, 2, 2, 2, 0.4), (1, 2, 3, 3, 0.1)]
    scored = spark.createDataFrame(rows, "query_id long, candidate_id long, q_token int, c_token int, score double")
    assert sorted((r.q_token, r.c_token) for r in matching.greedy_matches(scored).collect()) == [(1, 1), (2, 2)]
    assert matching.weights(-1.0, 0.0, defaults=(0.6, 0.4)) == (0.6, 0.4)


def test_empty_policies(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 2)], "query_id long, candidate_id long")
    tokens = spark.createDataFrame([(1, 1, 4)], "map_id long, token int, area long")
    matches = spark.createDataFrame([(1, 2, 1, 1, 0.5)], "query_id long, candidate_id long, q_token int, c_token int, score double")
    assert {r.query_id: r.score for r in matching.map_scores(pairs, tokens, matches).collect()} == {1: 0.5, 3: 0.0}
    assert {r.query_id for r in matching.map_scores(pairs, tokens, matches, "drop").collect()} == {1}


def test_metrics_by_hand(spark):
    rows = [(1, 1, 1.0, 1.0, 1.0, 1.0), (1, 2, 0.0, 0.0, 0.0, 0.0), (1, 3, 1.0, 0.0, 0.5, 0.5)]
    ranked = spark.createDataFrame(rows, "query_id long, rk long, hit double, exact double, jac double, gain double")
    pool = ranked.drop("rk").unionByName(spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0, 0.0)], "query_id long, hit double, exact double, jac double, gain double"))
    out = {r.query_id: r for r in metrics.query_metrics(ranked, pool, (2,)).collect()}
    assert out[1].ap_hit == pytest.approx((1 + 2 / 3) / 3)
    assert out[1].ndcg_2 == pytest.approx(1 / (1 + 1 / math.log2(3)))
    assert out[1].precision_2 == 0.5 and out[1].recall_2 == pytest.approx(1 / 3)
    assert out[2].n_ranked == 0 and out[2].ndcg_2 == 0.0


def test_missing_ids_are_named(spark):
    wanted, known = spark.createDataFrame([(k,) for k in range(9)], "id long"), spark.createDataFrame([(0,)], "id long")
    with pytest.raises(ValueError, match="1, 2, 3, 4, 5$"):
        ranking.check_ids(wanted, known, "id")


def test_split_sizes(spark):
    for n in range(1, 40):
        a, b = spark.range(1).select(*sampling.split_sizes(F.lit(n))).first() if n in (1, 2, 3, 5, 10, 39) else (None, None)
        if a is not None:
            assert a + b <= n and (n < 3 or (a >= 1 and b >= 1 and n - a - b >= 1))


def test_klarf_versions():
    old = 'FileVersion 1 2;\nLotID "L1";\nWaferID "W7";\nDiePitch 1.5e3 2000;\nDefectRecordSpec 4 DEFECTID XINDEX YINDEX XREL ;\nDefectList\n1 2 3 N\n2 -4 5 1.25;\nEndOfFile;'
    head, rows = klarf.parse(old)
    assert head == {"wafer": "W7", "lot": "L1", "pitch_x": 1500.0, "pitch_y": 2000.0}
    assert rows == [(1.0, 2.0, 3.0, None, None, None), (2.0, -4.0, 5.0, 1.25, None, None)]
    new = 'Record FileRecord "1.8" { Record LotRecord "L2" { Record WaferRecord "W1" { Field DiePitch 2 {10, 20} List DefectList { Columns 4 { int32 DEFECTID, int32 XINDEX, int32 YINDEX, int32 CLASSNUMBER } Data 2 { 1, 0, 1, 3; 2, 1, 1, 4; } } } } }'
    head, rows = klarf.parse(new)
    assert (head["lot"], head["wafer"], head["pitch_x"]) == ("L2", "W1", 10.0) and rows[1] == (2.0, 1.0, 1.0, None, None, 4.0)
    with pytest.raises(ValueError, match="YINDEX"):
        klarf.parse("DefectRecordSpec 2 DEFECTID XINDEX ;\nDefectList\n1 2;")


def test_png_filters():
    import struct
    import zlib

    image = np.array([[10, 20, 30, 255], [12, 18, 33, 127], [200, 3, 90, 0], [1, 2, 3, 4], [9, 9, 9, 9]], np.int32)
    raw, above = b"", np.zeros(4, np.int32)
    for how, line in enumerate(image):
        left = np.concatenate([[0], line[:-1]])
        corner = np.concatenate([[0], above[:-1]])
        near = left + above - corner
        paeth = np.where((abs(near - left) <= abs(near - above)) & (abs(near - left) <= abs(near - corner)), left, np.where(abs(near - above) <= abs(near - corner), above, corner))
        guess = [0 * line, left, above, (left + above) // 2, paeth][how]
        raw += bytes([how]) + bytes(((line - guess) % 256).tolist())
        above = line
    blank = images.encode_grey(np.zeros((5, 4), np.uint8))
    at = blank.index(b"IDAT")
    size = struct.unpack(">I", blank[at - 4 : at])[0]
    body = zlib.compress(raw)
    data = blank[: at - 4] + struct.pack(">I", len(body)) + b"IDAT" + body + b"\0\0\0\0" + blank[at + 8 + size :]
    assert (images.decode_grey(data) == image).all() and images.shape(data) == (5, 4)
    assert images.status_of(image)[0, 3] == 2 and images.status_of(image)[1, 3] == 1


def test_npz_collections(spark, tmp_path):
    maps, labels = np.arange(3 * 4, dtype=np.uint8).reshape(3, 2, 2) % 3, np.array([[0, 1], [0, 0], [1, 1]])
    np.savez(tmp_path / "a.npz", x=maps, y=labels)
    out = arrays.read_npz(spark, str(tmp_path)).orderBy("original_index").collect()
    assert [(r.original_index, r.bins) for r in out] == [(0, maps[0].ravel().tolist()), (2, maps[2].ravel().tolist())]


def test_tables_need_their_columns(spark):
    path = scratch_path(spark, "t")
    tables.write_csv(spark.createDataFrame([(1, 2)], "query_id long, candidate_id long"), path)
    with pytest.raises(ValueError, match="similarity_score"):
        tables.read_csv(spark, path, schemas.RANKINGS)


def test_settings(tmp_path):
    path = tmp_path / "run.json"
    path.write_text(json.dumps({"k": 3, "mode": "cc"}))
    assert settings.merge({"k": 1, "mode": "", "x": 9}, str(path), mode="arc", x=None) == {"k": 3, "mode": "arc", "x": 9}
    with pytest.raises(ValueError, match="z"):
        settings.merge({"k": 1}, z=2)
    with pytest.raises(ValueError, match="twice"):
        settings.batch({"experiments": [{"id": "a"}, {"id": "a"}]})
    assert settings.batch({"common": {"k": 1}, "experiments": [{"id": "a"}, {"id": "b", "k": 2}]}) == [{"k": 1, "id": "a"}, {"k": 2, "id": "b"}]
