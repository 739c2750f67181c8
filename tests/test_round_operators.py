"""Benchmarks, dense tokens, merges, clusters and mixtures against plain loops on a few maps."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import grid as G
from gridloom.functions import moments
from gridloom.operators import benchmark as B
from gridloom.operators import cluster as C
from gridloom.operators import dense as D
from gridloom.operators import matching as M
from gridloom.operators import merge as J
from gridloom.operators import mixture as X
from gridloom.operators import similarity as S
from gridloom.operators import transforms as V

H = W = 12
VALID = [int((k // W - 5.5) ** 2 + (k % W - 5.5) ** 2 <= 36) for k in range(H * W)]


def some_maps(n: int, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    return [(k, [int(v and r.random() < 0.1 + 0.04 * (k % 8)) for v in VALID], VALID) for k in range(n)]


@pytest.fixture(scope="module")
def maps(spark):
    return spark.createDataFrame(some_maps(24), "map_id long, mask array<int>, valid array<int>")


def grid(cells) -> np.ndarray:
    return np.array(cells).reshape(H, W)


def moved(mask: np.ndarray, dr: int, dc: int) -> np.ndarray:
    out = np.zeros_like(mask)
    for r, c in np.argwhere(mask):
        if 0 <= r + dr < H and 0 <= c + dc < W:
            out[r + dr, c + dc] = 1
    return out


def test_variants_are_what_their_names_say(spark, maps):
    got = {(x.map_id, x.transform_type): grid(x.status) for x in B.variant_maps(maps, H, W).collect()}
    valid = grid(VALID)
    for k, mask, _ in some_maps(24):
        mask = grid(mask)
        n, own = mask.sum(), {name: got[k, name] for name, _ in B.VARIANTS}
        status = lambda m: np.where(valid == 0, 0, np.where(m > 0, 2, 1))
        assert (own["identity"] == status(mask)).all()
        assert (own["rot_90"] == np.rot90(status(mask))).all() and (own["rot_180"] == np.rot90(status(mask), 2)).all()
        assert (own["shift_mild"] == status(moved(mask, 1, 1))).all() and (own["shift_strong"] == status(moved(mask, 2, 1))).all()
        size = lambda name: int((own[name] == 2).sum())
        share = lambda x: max(1, round(n * x))
        assert size("noise_mild") == n + share(0.03) and size("noise_strong") == n + share(0.15)
        assert size("dropout_mild") == n - share(0.10) and size("dropout_strong") == n - share(0.45)
        assert ((own["noise_strong"] == 2) >= (mask > 0)).all() and ((own["dropout_strong"] == 2) <= (mask > 0)).all()
        extra = np.argwhere((own["cluster_extra"] == 2) & (mask == 0))
        assert len(extra) and np.ptp(extra[:, 0]) <= 4 and np.ptp(extra[:, 1]) <= 4
        assert 0 < size("cluster_dropout") < n


def test_negatives_are_picked_in_turn(spark):
    """Against the sequential choice: labels, area and place decide, ties to the smaller id, none twice."""
    r = random.Random(2)
    rows = [(k, r.randrange(0, 30), float(r.randrange(12)), float(r.randrange(12)), sorted({r.choice("abc") for _ in range(r.randrange(3))})) for k in range(40)]
    own = spark.createDataFrame(rows, "map_id long, area int, row double, column double, labels array<string>")
    lists = B.negative_lists(own, "map_id % 5 = 0")
    got = {}
    for x in B.pick_negatives(lists).orderBy("query_id", "slot").collect():
        got.setdefault(x.query_id, []).append((x.negative_type, x.candidate_id))
    mix = lambda a, b, s: (((a % 65536) * 4096 + b) * 2654435761 + s * 40503) % 4294967296
    for q in (x for x in rows if x[0] % 5 == 0):
        used, expected = {q[0]}, []
        area = lambda c, q=q: abs(q[1] - c[1]) / max(q[1], 1)
        apart = lambda c, q=q: math.hypot(q[2] - c[2], q[3] - c[3])
        jaccard = lambda c, q=q: len(set(q[4]) & set(c[4])) / max(len(set(q[4]) | set(c[4])), 1)
        keys = {"random": lambda c, q=q: mix(q[0], c[0], 7), "area": area, "position": apart, "similar": lambda c: area(c) + apart(c), "hard": lambda c: -(area(c) + apart(c))}
        for kind in B.NEGATIVES:
            free = [c for c in rows if c[0] not in used]
            name = B.CRITERION[kind]
            pool = [c for c in free if (jaccard(c) >= 1 if name == "hard" else jaccard(c) <= 0)]
            key = keys[name]
            if not pool:
                pool, key = [c for c in free if jaccard(c) <= 0], keys["random"]
            if not pool:
                pool, key = free, keys["random"]
            best = min(pool, key=lambda c: (round(key(c), 9), c[0]))
            used.add(best[0])
            expected.append((kind, best[0]))
        assert got[q[0]] == expected


def test_rules_join_the_first_of_each_kind(spark):
    queries = spark.createDataFrame([(20, 0), (40, 1)], "map_id long, query_order long")
    negatives = spark.createDataFrame([(20, s, n, 100 + s) for s, n in enumerate(B.NEGATIVES)] + [(40, 0, B.NEGATIVES[0], 7)], "query_id long, slot long, negative_type string, candidate_id long")
    rows = B.benchmark_rows(queries, negatives)
    assert rows.count() == 2 * 13 + 9 and rows.select("sample_id").distinct().count() == 35
    prefer = B.benchmark_preferences(rows).collect()
    assert len([p for p in prefer if p.query_id == 0]) == len(B.RULES) == 16
    assert {p.rule_type for p in prefer if p.query_id == 21} == {r[2] for r in B.RULES if r[1] == B.NEGATIVES[0] or r[1] in dict(B.VARIANTS)}
    area = next(p for p in prefer if p.query_id == 0 and p.rule_type == "mild_shift_over_same_area_wrong_shape")
    assert area.less_preferred_candidate_id == 1 + 12 + 2


def test_changed_copies_are_different_enough(spark, maps):
    masks = {k: set(np.flatnonzero(m).tolist()) for k, m, _ in some_maps(24)}
    out = V.changed_copies(maps, H, W).collect()
    assert len(out) == 24 * 5 and sum(x.accepted for x in out) > 100
    for x in out:
        own, cells = masks[x.map_id], set(x.cells)
        assert all(VALID[i] for i in cells) and abs(x.iou - len(own & cells) / len(own | cells)) < 1e-9
        if x.accepted:
            assert x.iou < 0.98 and max(3, math.ceil(0.3 * len(own))) <= len(cells) <= 0.8 * sum(VALID)
        else:
            assert (x.dx, x.dy, x.kind) == (3, -3, "translate")
        if x.kind == "translate":
            assert cells == {i for i in ((p // W + x.dy) * W + p % W + x.dx for p in own if 0 <= p // W + x.dy < H and 0 <= p % W + x.dx < W) if VALID[i]}


def test_similarities_on_bits_are_those_on_cells(spark, maps):
    own = S.with_bits(maps.withColumn("status", F.zip_with("mask", "valid", lambda m, v: F.when(v == 0, 0).when(m > 0, 2).otherwise(1))), H, W)
    pairs = S.blocked_pairs(own.where("map_id < 5"), own, "map_id")
    assert pairs.count() == 5 * 23
    both = pairs.select(S.mask_sums(H, W).alias("fast"), S.cell_sums(F.col("q_mask"), F.col("c_mask"), F.col("q_status")).alias("slow")).collect()
    assert all(x.fast == x.slow for x in both)


def test_chamfer_looks_distances_up(spark, maps):
    """Maps of one inspected area take the lookup; with another area the search gives what a loop gives."""
    other = maps.where("map_id = 3").select((F.col("map_id") + 100).alias("map_id"), "mask", F.transform("valid", lambda v, i: F.when(i < 40, 0).otherwise(v)).alias("valid"))
    own = maps.unionByName(other).withColumn("status", F.zip_with("mask", "valid", lambda m, v: F.when(v == 0, 0).when(m > 0, 2).otherwise(1)))
    held = S.with_distances(own.select("map_id", "mask", "status"), H, W)
    pairs = S.blocked_pairs(held.where("map_id in (1, 103)"), held, "map_id")
    rows = pairs.select("q_map_id", "c_map_id", "q_mask", "c_mask", "q_status", (F.col("q_area") == F.col("c_area")).alias("same"), S.chamfer(H, W).alias("score")).collect()
    assert sum(x.same for x in rows) == 23 and len(rows) == 2 * 24
    for x in rows:
        a, b = ([(k // W, k % W) for k in range(H * W) if m[k] and x.q_status[k]] for m in (x.q_mask, x.c_mask))
        near = lambda p, q: sum(min(math.dist(i, j) for j in q) for i in p) / len(p)
        assert abs(x.score - (1 - min((near(a, b) + near(b, a)) / math.hypot(H, W), 1))) < 1e-9


@pytest.mark.parametrize("mode", D.TOKEN_MODES)
def test_dense_tokens_by_hand(spark, mode):
    h = w = 4
    defect, valid = [0] * 16, [1] * 12 + [0] * 4
    defect[5] = 1
    features = [[float(k), 3.0] for k in range(16)]
    df = spark.createDataFrame([(1, features, defect, valid), (2, features, [0] * 16, valid), (3, features, [0] * 16, [0] * 16)], "map_id long, features array<array<double>>, defect array<int>, valid array<int>")
    got = {x.map_id: x for x in D.dense_tokens(df, h, w, mode, max_tokens=10).collect()}
    expected = {"defect": [5], "defect_band": [0, 1, 2, 4, 5, 6, 8, 9, 10], "valid": list(range(10)), "all": list(range(10))}[mode]
    assert got[1].cells == expected and got[2].cells == list(range(10)) and got[3].cells == list(range(10))
    assert got[1].weights == [pytest.approx(1.1 if c == 5 else 0.1) for c in expected]
    assert all(abs(math.hypot(*t) - 1) < 1e-9 and abs(t[0] / t[1] - c / 3) < 1e-9 for t, c in zip(got[1].tokens, expected))
    with pytest.raises(ValueError):
        D.dense_tokens(df, h, w, "none")


def test_dense_scores_by_hand(spark):
    rows = [(1, [0, 3], [[1.0, 0.0], [0.0, 1.0]], [1.1, 0.1]), (2, [0], [[1.0, 0.0]], [1.0]), (3, [], [], [])]
    df = spark.createDataFrame(rows, "map_id long, cells array<int>, tokens array<array<double>>, weights array<double>")
    got = {(x.query_id, x.candidate_id): x.score for x in D.dense_map_scores(df, df, 2, 2).collect()}
    assert got[1, 2] == pytest.approx(1.1 / 1.2) and got[2, 1] == pytest.approx((1.0 + 0.0) / 2) and got[1, 3] == got[3, 1] == 0.0
    mutual = {(x.query_id, x.candidate_id): (x.pairs, x.score) for x in D.mutual_scores(df, df).collect()}
    assert mutual[1, 2] == (1, 0.5) and mutual[2, 1] == (1, 1.0) and mutual[3, 1] == (0, 0.0)


def test_contraction_keeps_the_order_of_joins(spark):
    edges = spark.createDataFrame([([(0, 1, "ring"), (1, 2, "line"), (0, 2, "blob"), (3, 4, "blob"), (2, 4, "ring")],)], "edges array<struct<a:int,b:int,reason:string>>")
    x = edges.select(J.contract(F.col("edges"), F.lit(6)).alias("x")).first().x
    assert x.labels == [0, 0, 0, 0, 0, 5] and x.reasons[0] == "ring+line" and x.reasons[5] == "single"


def test_merged_statistics_are_those_of_all_pixels(spark):
    """Two halves of a line, a blob of two parts, and a far token that stays alone."""
    parts = {1: [(1, c) for c in range(1, 6)], 2: [(1, c) for c in range(8, 12)], 3: [(8, 1), (8, 2), (9, 1), (9, 2), (10, 2)], 4: [(8, 4), (9, 4), (10, 4), (9, 5), (8, 5)], 5: [(11, 11), (11, 10), (10, 11), (10, 10), (9, 11)]}
    cells = spark.createDataFrame([(7, t, r, c, 1.0, 1) for t, own in parts.items() for r, c in own], "map_id long, token int, r int, c int, n double, edges int")
    gates = {**J.GATES, "min_area": 4, "ring_radial_gap": -1.0, "line_gap": 7.0, "blob_bbox": 20}
    got = {x.token: x for x in J.merged_tokens(cells, 12, 12, gates=gates).collect()}
    assert {t: (x.parts, x.reason) for t, x in got.items()} == {1: (2, "line"), 3: (2, "blob"), 5: (1, "single")}
    pixels = np.array(parts[1] + parts[2], float)
    values = np.linalg.eigvalsh(np.cov(pixels.T, bias=True))
    assert got[1].centroid_c == pytest.approx(pixels[:, 1].mean()) and got[1].lambda_1 == pytest.approx(values[1]) and got[1].area == 9 and (got[1].c_min, got[1].c_max) == (1, 11)


def test_radius_and_clusters_of_a_map(spark):
    blob = [(r, c) for r in range(4) for c in range(4)]
    far = [(11, 11), (11, 0), (0, 11)]
    mask = [int((k // W, k % W) in blob + far) for k in range(H * W)]
    few = [int(k in (0, 50, 100)) for k in range(H * W)]
    df = C.with_radius(spark.createDataFrame([(1, mask), (2, few), (3, [0] * H * W)], "map_id long, mask array<int>"), W)
    sized = {x.map_id: (len(x.points), x.radius) for x in df.collect()}
    points = np.array(blob + far, float)
    curve = np.sort(np.sort(np.linalg.norm(points[:, None] - points[None], axis=2), axis=1)[:, 4])
    bend = np.gradient(np.gradient(curve)).round(9)
    assert sized[1] == (19, pytest.approx(max(curve[len(bend) // 4 + bend[len(bend) // 4 :].argmax()], 0.5))) and sized[2] == (3, 3.0) and sized[3] == (0, 3.0)
    labels = {(x.r, x.c): x.cluster for x in C.dbscan_by_radius(df.where("map_id = 1").withColumn("radius", F.lit(1.5)), W).collect()}
    assert {labels[p] for p in blob} == {2} and all(labels[p] is None for p in far)  # (0, 0) has three neighbours: no core point


def planted(seed: int) -> list[int]:
    r = np.random.default_rng(seed)
    hit = np.zeros((20, 20), int)
    for centre, spread in (((4, 4), (1.2, 1.2)), ((14, 5), (0.6, 2.0)), ((9, 15), (2.5, 0.7))):
        own = np.rint(r.normal(centre, spread, (40, 2))).astype(int).clip(0, 19)
        hit[own[:, 0], own[:, 1]] = 1
    return np.flatnonzero(hit).tolist()


def plain_round(points, comps, cost):
    """One round for one map, by numpy."""
    def density(c):
        cov = np.array([[c["srr"], c["src"]], [c["src"], c["scc"]]])
        d = points - [c["mr"], c["mc"]]
        return np.log(c["weight"]) - np.log(2 * np.pi) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * (d @ np.linalg.inv(cov) * d).sum(axis=1)

    p = np.stack([density(c) for c in comps], axis=1)
    s = np.exp(p - np.log(np.exp(p).sum(axis=1, keepdims=True)))
    n = s.sum(axis=0)
    weight = np.where(n == n.max(), np.maximum(n - cost, 1e-3), n - cost)
    out = []
    for k in np.flatnonzero(weight > 0):
        m = (s[:, k : k + 1] * points).sum(axis=0) / n[k]
        d = points - m
        cov = ((s[:, k : k + 1] * d).T @ d + np.eye(2) * X.PRIOR_POINTS * X.PRIOR_VARIANCE) / (n[k] + X.PRIOR_POINTS)
        out.append({"k": comps[k]["k"], "weight": weight[k] / weight[weight > 0].sum(), "mr": m[0], "mc": m[1], "srr": cov[0, 0], "scc": cov[1, 1], "src": cov[0, 1]})
    return out


def test_mixtures_of_planted_blobs(spark):
    cells = {k: planted(k) for k in range(3)}
    maps = spark.createDataFrame([*cells.items(), (8, [5]), (9, [])], "map_id long, points array<int>")
    points = maps.select("map_id", F.explode("points").alias("i")).select("map_id", G.row_of(F.col("i"), 20).cast("double").alias("r"), G.column_of(F.col("i"), 20).cast("double").alias("c")).cache()
    now = X.first_components(maps, 20, 6)
    assert {x.map_id for x in now.select("map_id").distinct().collect()} == {0, 1, 2}
    now = spark.createDataFrame(now.collect(), now.schema)
    before = {}
    for _ in range(5):
        for x in X.objective(points, now).collect():
            held = before.get(x.map_id)
            assert held is None or held[0] != x.components or x.objective >= held[1] - 1e-6
            before[x.map_id] = (x.components, x.objective)
        after = X.em_round(points, now)
        rows = after.collect()
        for k in cells:
            own = np.array([(i // 20, i % 20) for i in cells[k]], float)
            expected = plain_round(own, sorted((x.asDict() for x in now.where(F.col("map_id") == k).collect()), key=lambda x: x["k"]), X.COST)
            got = sorted((x.asDict() for x in rows if x.map_id == k), key=lambda x: x["k"])
            assert [x["k"] for x in got] == [x["k"] for x in expected]
            assert all(abs(g[n] - e[n]) < 1e-6 for g, e in zip(got, expected) for n in e)
        now = spark.createDataFrame(rows, after.schema)
    labels = X.mixture_labels(points, now)
    assert labels.count() == sum(map(len, cells.values()))
    first = {(x.r, x.c): x.component for x in labels.where("map_id = 0").collect()}
    mode = lambda rows, cols: {first[p] for p in first if p[0] in rows and p[1] in cols}
    assert not mode(range(3, 6), range(3, 6)) & mode(range(8, 11), range(14, 17))


def test_extents_take_the_first_that_is_there(spark):
    names = [f"{s}_{x}" for s in "qc" for x in (*M.EXTENTS, "radial")]
    rows = [(None, 0.5, 0.1, 0.2, 0.9, 0.7, 0.4, 0.3, 0.3, 0.9), (None, None, 0.1, 0.9, 0.9, None, None, 0.2, 0.9, 0.9), (None, None, None, 0.4, 0.5, 0.9, 0.9, 0.9, 0.9, 0.9)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    got = [x.e for x in df.select(M.edge_extent(df.columns).alias("e")).collect()]
    assert got == [pytest.approx(math.exp(-0.2 / 0.2)), 1.0, 1.0]


def test_canvas_and_moments_by_the_formula():
    """A single pixel fills the disc, so only moments without an angle are there; a bar keeps its moments when it is moved."""
    image = moments.canvas_of(np.array([3.0]), np.array([5.0]), (3.0, 5.0))
    assert image.shape == (48, 48) and image[23, 23] == 1 and image[7:41, 7:41].all() and not image[:6].any()  # half of 23.5 / sqrt(0.5), less than a cell over
    own = moments.zernike(np.array([3.0]), np.array([5.0]))
    assert abs(np.linalg.norm(own) - 1) < 1e-9 and all(own[k] < 0.03 for k, (_, m) in enumerate(moments.orders()) if m % 4)
    bar = np.array([(0, c) for c in range(6)], float)
    a, b = moments.zernike(bar[:, 0], bar[:, 1]), moments.zernike(bar[:, 1] + 4, bar[:, 0] + 2)
    assert np.abs(a - b).max() < 0.02 and not moments.zernike(np.zeros(0), np.zeros(0)).any()


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_collections_are_read_by_ranges(spark, tmp_path, save):
    from gridloom.sources import arrays, collections

    r = np.random.default_rng(0)
    for k, n in enumerate((1000, 30)):
        save(tmp_path / f"c{k}.npz", maps=r.integers(0, 3, (n, 5, 4)).astype(np.uint8), labels=r.integers(0, 2, (n, 3)).astype(np.int32))
    whole = sorted(map(tuple, ((x.path.rsplit("/", 1)[-1], *x[1:]) for x in arrays.read_npz(spark, str(tmp_path)).collect())))
    found = collections.read_collections(spark, str(tmp_path), rows=64)
    assert found.rdd.getNumPartitions() == 16 + 1
    assert sorted((x.path.rsplit("/", 1)[-1], *x[1:]) for x in found.collect()) == whole
    some = found.where("original_index >= 500 AND original_index < 600 AND h = 5")
    assert some.rdd.getNumPartitions() == 2  # of 17: the bounds reached the source
    assert sorted((x.path.rsplit("/", 1)[-1], *x[1:]) for x in some.collect()) == [x for x in whole if 500 <= x[1] < 600]
    assert found.where("original_index = 7").count() == sum(x[1] == 7 for x in whole)


def test_spectral_clusters_against_the_matrix(spark):
    from gridloom.operators import spectral as P

    blobs = [(r, c) for r in range(3) for c in range(3)] + [(r, c) for r in range(9, 12) for c in range(16, 19)] + [(18, 1), (18, 2), (19, 1), (19, 2)]
    points = np.array(blobs + [(0, 19)], float)
    own = P.laplacian(points)
    for i in range(len(points)):
        for j in range(len(points)):
            d = [sum(math.exp(-math.dist(points[k], q) ** 2 / 18) for m, q in enumerate(points) if m != k and math.dist(points[k], q) <= 15) for k in (i, j)]
            w = math.exp(-math.dist(points[i], points[j]) ** 2 / 18) if i != j and math.dist(points[i], points[j]) <= 15 else 0.0
            assert abs(own[i, j] - ((i == j) - (w / math.sqrt(d[0] * d[1]) if w else 0.0))) < 1e-9
    lonely = P.laplacian(np.array([(0, 0), (0, 1), (90, 90)], float))
    assert lonely[2].tolist() == [0, 0, 1]  # no neighbour: a row of its own 1
    assert P.gap_size(np.array([0.0, 0.1, 0.2, 0.9, 1.0])) == 3 and P.gap_size(np.array([0.0, 1.0])) == 2
    cells = [r * 20 + c for r, c in sorted(blobs)]
    maps = spark.createDataFrame([(1, cells), (2, [3, 4]), (3, [])], "map_id long, points array<int>")
    rows = P.spectral_clusters(maps, 20, sigma=2.0, clusters=3).collect()
    assert len(rows) == len(cells) + 2 and all(x.cluster is None for x in rows if x.map_id == 2)
    found = {}
    for x in rows:
        if x.map_id == 1:
            found.setdefault(x.cluster, set()).add((x.r, x.c))
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, (blobs[:9], blobs[9:18], blobs[18:])))
    assert set(found) == {min(r * 20 + c for r, c in own) + 1 for own in found.values()}


def test_selection_spreads_over_kinds_first(spark):
    from gridloom.operators import segment as T

    rows = [(1, t, k, a, 0.9, 0.5) for t, k, a in ((1, "irregular", 100), (2, "irregular", 81), (3, "irregular", 64), (4, "line", 4), (5, "blob", 4), (6, "central", 4), (7, "irregular", 49))]
    tokens = spark.createDataFrame(rows, "map_id long, token int, kind string, area int, radial double, fill double")
    picked = lambda k: [x.token for x in T.select_diverse(tokens, k).orderBy("place").collect()]
    assert picked(2) == [6, 5] and picked(3) == [6, 5, 4]
    assert picked(5) == [6, 5, 1, 2, 4]  # central, blob and line lead, then the two largest; shown by kind and a hundredth of the area


def test_signatures_are_those_of_canonical_json(spark):
    import hashlib
    import json

    from gridloom.operators import segment as T

    df = spark.createDataFrame([(3, 7, [(2, 1), (0, 5), (0, 4)], "line")], "map_id long, token int, pixels array<struct<r:int,c:int>>, kind string")
    text = json.dumps({"map_id": 3, "token_id": 7, "proposal_method": "cc", "proposal_type": "line", "proposal_source": "x", "pixels": [(0, 4), (0, 5), (2, 1)]}, sort_keys=True, separators=(",", ":"))
    assert df.select(T.token_signature("cc", F.col("kind"), "x").alias("s")).first().s == hashlib.sha1(text.encode()).hexdigest()
