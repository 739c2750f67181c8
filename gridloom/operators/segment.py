"""From grids to region tokens."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid as G
from ..functions import segment as S
from ..sources.scratch import written


def eigenvalues(srr: Column, scc: Column, src: Column) -> tuple[Column, Column]:
    """The larger and the smaller eigenvalue of [[srr, src], [src, scc]]."""
    mean, half = (srr + scc) / 2, F.sqrt(((srr - scc) / 2) ** 2 + src * src)
    return mean + half, F.greatest(mean - half, F.lit(0.0))


#: Sectors whose counts tell how evenly a token is spread around the middle.
SECTORS = 12


def region_cells(maps: DataFrame, h: int, w: int, mask: str = "mask", offsets=G.NEIGHBOURS_8) -> DataFrame:
    """map_id, token, r, c, n, edges for every cell of every region; token is the region's first cell plus one."""
    labelled = S.with_components(maps.select("map_id", "counts", mask), "_labels", mask, h, w, offsets).withColumn("_edges", S.exposed_edges(F.col("_labels"), h, w))
    rows = labelled.select("map_id", F.posexplode(F.arrays_zip(F.col("_labels").alias("token"), F.col("counts").alias("n"), F.col("_edges").alias("edges"))).alias("i", "x")).where("x.token > 0")
    return rows.select("map_id", F.col("x.token").alias("token"), G.row_of(F.col("i"), w).alias("r"), G.column_of(F.col("i"), w).alias("c"), F.col("x.n").cast("double").alias("n"), F.col("x.edges").alias("edges"))


def token_statistics(cells: DataFrame, h: int, w: int, weighted: bool = False, radius: float | None = None) -> DataFrame:
    """One row per region: area, mass, centroid, box, principal axes, perimeter, ratios, radial place, angles and pixels.

    weighted: centroid, axes and mean radius by count (at least 1e-6 each) rather than by cell; the radii's spread is by
    cell always. radius: what radii are divided by; by default half of the grid's diagonal. angular_cv: how unevenly the
    cells are spread over twelve sectors, their deviation over their mean.
    """
    weight = F.greatest("n", F.lit(1e-6)) if weighted else F.lit(1.0)
    radius = radius or math.hypot(h, w) / 2
    away = F.sqrt((F.col("r") - h / 2) ** 2 + (F.col("c") - w / 2) ** 2) / radius
    turn = F.pmod(F.degrees(F.atan2(F.col("r") - F.lit(h / 2), F.col("c") - F.lit(w / 2))), F.lit(360.0))
    sector = F.least(F.floor(turn / (360.0 / SECTORS)), F.lit(SECTORS - 1))
    rows = cells.withColumn("_w", weight).withColumn("_d", away)
    mean = lambda e: F.sum(F.col("_w") * e) / F.sum("_w")
    own = rows.groupBy("map_id", "token").agg(
        F.count("*").alias("area"), F.sum("n").alias("mass"), F.max("n").alias("peak"), F.sum("edges").cast("bigint").alias("perimeter"),
        mean(F.col("r")).alias("centroid_r"), mean(F.col("c")).alias("centroid_c"), mean(F.col("r") * F.col("r")).alias("_rr"), mean(F.col("c") * F.col("c")).alias("_cc"), mean(F.col("r") * F.col("c")).alias("_rc"),
        F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.min("c").alias("c_min"), F.max("c").alias("c_max"), mean(F.col("_d")).alias("_dm"), F.stddev_pop("_d").alias("radial_std"), F.array(*[F.count_if(sector == k) for k in range(SECTORS)]).alias("_sectors"),
        F.array_sort(F.collect_list(F.struct("r", "c"))).alias("pixels"),
    )
    large, small = eigenvalues(F.col("_rr") - F.col("centroid_r") ** 2, F.col("_cc") - F.col("centroid_c") ** 2, F.col("_rc") - F.col("centroid_r") * F.col("centroid_c"))
    tall, wide = F.col("r_max") - F.col("r_min") + 1, F.col("c_max") - F.col("c_min") + 1
    bits = S.angle_bins(F.col("pixels"), h / 2, w / 2)
    own = own.withColumn("lambda_1", large).withColumn("lambda_2", small).withColumn("_bits", bits)
    theta = 0.5 * F.degrees(F.atan2(2 * (F.col("_rc") - F.col("centroid_r") * F.col("centroid_c")), (F.col("_cc") - F.col("centroid_c") ** 2) - (F.col("_rr") - F.col("centroid_r") ** 2)))
    set_bits = F.size(F.filter("_bits", lambda b: b))
    return own.select(
        "map_id", "token", "area", "mass", "peak", "centroid_r", "centroid_c", "r_min", "c_min", "r_max", "c_max", "lambda_1", "lambda_2", "perimeter", "pixels",
        F.pmod(theta, F.lit(180.0)).alias("orientation"), (F.col("perimeter") / F.col("area")).alias("compactness"), (F.col("area") / (tall * wide)).alias("fill"), (F.greatest(tall, wide) / F.least(tall, wide)).alias("aspect"),
        (F.sqrt((F.col("centroid_r") - h / 2) ** 2 + (F.col("centroid_c") - w / 2) ** 2) / radius).alias("radial"), F.col("_dm").alias("radial_mean"), "radial_std", (F.sqrt(F.aggregate("_sectors", F.lit(0.0), lambda s, x: s + (x - F.col("area") / SECTORS) * (x - F.col("area") / SECTORS)) / SECTORS) / (F.col("area") / SECTORS)).alias("angular_cv"),
        (set_bits / 72.0).alias("coverage"), (S.longest_run(F.col("_bits")) / 72.0).alias("max_run"), (S.longest_run(F.transform("_bits", lambda b: ~b)) / 72.0).alias("max_gap"),
    )


def centre_occupancy() -> Column:
    """The share of set cells in the disc around the middle of a token's box, three tenths of its shorter half wide, one cell at least."""
    tall, wide = F.col("r_max") - F.col("r_min") + 1, F.col("c_max") - F.col("c_min") + 1
    radius = F.greatest(0.30 * F.greatest(F.least(tall, wide) / 2.0, F.lit(1.0)), F.lit(1.0))
    inside = lambda y, x: (y - (tall - 1) / 2.0) * (y - (tall - 1) / 2.0) + (x - (wide - 1) / 2.0) * (x - (wide - 1) / 2.0) <= radius * radius
    every = F.flatten(F.transform(F.sequence(F.lit(0), tall - 1), lambda y: F.filter(F.sequence(F.lit(0), wide - 1), lambda x: inside(y, x))))
    hit = F.filter("pixels", lambda p: inside(p["r"] - F.col("r_min"), p["c"] - F.col("c_min")))
    return F.when(F.size(every) > 0, F.size(hit) / F.size(every)).otherwise(0.0)


def token_kind(ring: bool = True) -> Column:
    """edge_ring, line, blob, central or irregular, in this order; `ring` False leaves edge_ring out. Values meet their bounds at nine places."""
    nine = lambda x: F.round(x, 9)
    elongation, radial = nine(F.col("lambda_1") / F.greatest("lambda_2", F.lit(1e-6))), nine("radial")
    kind = F.when((elongation >= 6) | (F.col("aspect") >= 4), "line").when((F.col("fill") >= 0.45) & (F.col("compactness") <= 1.6), "blob").when(radial <= 0.35, "central").otherwise("irregular")
    return F.when((radial >= 0.65) & (F.col("coverage") >= 0.25) & (nine("radial_std") <= 0.14), "edge_ring").otherwise(kind) if ring else kind


def adaptive(h: int, w: int, valid: int, min_area: int = 5, top_k: int = 6) -> tuple[int, int]:
    """(min_area, top_k) for a grid; 5 and 6 ask for the grid's own values, anything else is taken as it is."""
    short = min(h, w)
    own_area, own_k = (2, 4) if short <= 12 else (max(3, round(0.01 * valid)), 6) if short <= 25 else (max(5, round(0.005 * valid)), 8)
    return (max(1, min(min_area, own_area)) if min_area == 5 else min_area), (max(1, min(top_k, own_k)) if top_k == 6 else top_k)


#: What each kind adds to a token's importance.
CC_BONUS = {"edge_ring": 2.0, "central": 1.5, "blob": 1.2, "line": 1.0, "irregular": 0.8}
RESIDUAL_BONUS = {"edge_ring": 3.0, "central": 2.5, "ring_arc": 2.0, "blob": 1.5, "line": 1.2, "irregular": 0.8}
DISPLAY_ORDER = {"edge_ring": 5.5, "central": 5.0, "ring_arc": 4.5, "blob": 4.0, "line": 3.5, "irregular": 3.0}


def _by_kind(values: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for kind, value in values.items():
        out = F.when(F.col("kind") == kind, value).otherwise(out)
    return out


def importance() -> Column:
    return F.sqrt("mass") + 0.25 * F.sqrt("area") + _by_kind(CC_BONUS)


def residual_importance() -> Column:
    return F.sqrt("area") + F.when(F.round("radial", 9) <= 0.35, 2.0).otherwise(0.0) + _by_kind(RESIDUAL_BONUS) + F.least("fill", F.lit(1.0))


def display_order() -> Column:
    return _by_kind(DISPLAY_ORDER) + 0.01 * F.col("area")


def token_signature(method: str, kind: Column | None = None, source: str = "") -> Column:
    """SHA-1 of a token's canonical JSON: map, sorted pixels, method, source, kind and token, keys in order, no spaces.

    The names must be plain ASCII without quotes or backslashes, as those of modes and kinds are.
    """
    kind = F.lit("") if kind is None else kind
    pixels = F.array_join(F.transform(F.array_sort("pixels"), lambda p: F.concat(F.lit("["), p["r"].cast("string"), F.lit(","), p["c"].cast("string"), F.lit("]"))), ",")
    text = F.concat(F.lit('{"map_id":'), F.col("map_id").cast("string"), F.lit(',"pixels":['), pixels, F.lit(f'],"proposal_method":"{method}","proposal_source":"{source}","proposal_type":"'), kind, F.lit('","token_id":'), F.col("token").cast("string"), F.lit("}"))
    return F.sha1(text.cast("binary"))


def keep_top(tokens: DataFrame, score: Column, k: int, min_area: int = 1) -> DataFrame:
    """The k best tokens of each map with `place`; ties to the token that starts first."""
    best = Window.partitionBy("map_id").orderBy(F.round(score, 9).desc(), "token")
    return tokens.where(F.col("area") >= min_area).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def select_diverse(tokens: DataFrame, k: int, kinds: int = 3) -> DataFrame:
    """At most k tokens of each map with `place`: first the best token of each of up to `kinds` kinds, the kinds in display
    order, then the best of all others; in display order. Best is by importance, ties to the token that starts first.
    """
    score = F.round(residual_importance(), 9)
    best = lambda *by: Window.partitionBy("map_id", *by).orderBy(F.desc("_score"), "token")
    own = tokens.withColumn("_score", score).withColumn("_leads", F.row_number().over(best("kind")) == 1)
    order = F.round(_by_kind(DISPLAY_ORDER) + 0.01 * F.col("_score"), 9)
    own = own.withColumn("_turn", F.row_number().over(Window.partitionBy("map_id", "_leads").orderBy(order.desc(), "token")))
    own = own.withColumn("_first", F.col("_leads") & (F.col("_turn") <= min(k, kinds)))
    own = own.withColumn("_firsts", F.count_if("_first").over(Window.partitionBy("map_id"))).withColumn("_rest", F.row_number().over(best("_first")))
    kept = own.where(F.col("_first") | (F.col("_rest") + F.col("_firsts") <= k))
    shown = Window.partitionBy("map_id").orderBy(F.round(display_order(), 9).desc(), "token")
    return kept.withColumn("place", F.row_number().over(shown)).drop("_score", "_leads", "_turn", "_first", "_firsts", "_rest")


def diverse_tokens(maps: DataFrame, h: int, w: int, valid: int, min_area: int = 5, top_k: int = 6, radius: float | None = None) -> DataFrame:
    """Mode `diverse`: regions of at least min_area cells, spread over kinds before score counts."""
    least, k = adaptive(h, w, valid, min_area, top_k)
    own = token_statistics(region_cells(maps, h, w), h, w, weighted=True, radius=radius or min(h, w) / 2).where(F.col("area") >= least)
    return select_diverse(own.withColumn("kind", token_kind()), k)


def cc_tokens(maps: DataFrame, h: int, w: int, valid: int, min_area: int = 5, top_k: int = 6) -> DataFrame:
    """Mode `cc`: regions of at least min_area cells, by importance."""
    least, k = adaptive(h, w, valid, min_area, top_k)
    own = token_statistics(region_cells(maps, h, w), h, w, weighted=True, radius=min(h, w) / 2)
    return keep_top(own.withColumn("kind", token_kind()), importance(), k, least)


def ring_band(maps: DataFrame, h: int, w: int, r_min: float = 0.65, band: float = 0.10) -> DataFrame:
    """Add `band_mask`: raw defects near the fullest of 12 rings between r_min and 1.05 of the valid radius.

    The rings are counted on the closed mask; the band is half as wide as `band` of the radius or 2.5 cells, whichever is less.
    """
    largest = min(h, w) / 2
    away = lambda i: F.sqrt((G.row_of(i, w) - h / 2) * (G.row_of(i, w) - h / 2) + (G.column_of(i, w) - w / 2) * (G.column_of(i, w) - w / 2)) / largest
    step = (1.05 - r_min) / 12
    closed = G.close_within(F.col("mask"), F.col("valid"), h, w)
    ring = F.transform(closed, lambda x, i: F.when((x > 0) & (away(i) >= r_min) & (away(i) <= 1.05), F.least(F.floor((away(i) - r_min) / step), F.lit(11)).cast("int")))
    counts = G.let(ring, lambda own: F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.size(F.filter(own, lambda x: x == k))))
    peak = G.let(counts, lambda n: F.when(F.array_max(n) > 0, F.array_position(n, F.array_max(n)).cast("int") - 1))
    half = min(band, 2.5 / largest)
    # the centre is bound once for a map, not worked out again for each cell
    near = lambda centre: F.transform("mask", lambda x, i: F.when((x > 0) & (away(i) >= r_min) & (F.abs(away(i) - centre) <= half), 1).otherwise(0))
    return maps.withColumn("band_mask", G.let(r_min + (peak + 0.5) * step, near))


def arc_ring_residual_tokens(maps: DataFrame, h: int, w: int, valid: int, min_area: int = 5, top_k: int = 6) -> DataFrame:
    """Mode `arc-ring-residual`: arcs in the ring band first, then the regions of what is left.

    Band regions whose 3x3 surroundings meet form a group. A group is an arc if it has min_area cells, spans 45 degrees
    and is not in many parts; arcs that cover 0.65 of the circle are edge rings. All arcs stay; residual regions fill up
    to top_k by importance; the result is in display order.
    """
    least, k = adaptive(h, w, valid, min_area, top_k)
    maps = written(maps.select("map_id", "counts", "valid", "mask"), "maps")  # read twice below
    banded = written(ring_band(maps, h, w), "banded")
    grouped = S.with_components(S.with_components(banded.select("map_id", "counts", "band_mask", G.dilate(F.col("band_mask"), h, w).alias("_grown")), "_parts", "band_mask", h, w), "_wide", "_grown", h, w)
    cell = F.arrays_zip(F.col("_parts").alias("part"), F.col("_wide").alias("token"), F.col("counts").alias("n"))
    rows = grouped.select("map_id", F.posexplode(cell).alias("i", "x")).where("x.part > 0").select("map_id", "x.*", G.row_of(F.col("i"), w).alias("r"), G.column_of(F.col("i"), w).alias("c"), F.lit(0).alias("edges"))
    parts = rows.groupBy("map_id", "token").agg(F.countDistinct("part").alias("parts"))
    arcs = token_statistics(rows.withColumn("n", F.col("n").cast("double")), h, w, weighted=True, radius=min(h, w) / 2).join(parts, ["map_id", "token"])
    arcs = arcs.where((F.col("area") >= least) & ((F.col("parts") - 1) / F.col("area") <= 0.2) & (F.col("coverage") * 360 >= 45)).drop("parts")
    arcs = arcs.withColumn("kind", F.when(F.col("coverage") >= 0.65, "edge_ring").otherwise("ring_arc"))
    arcs = arcs.withColumn("_rank", F.row_number().over(Window.partitionBy("map_id").orderBy(F.desc("area"), "token"))).where("_rank <= 5").drop("_rank")
    arcs = written(arcs, "arcs")
    taken = arcs.groupBy("map_id").agg(F.flatten(F.collect_list(F.transform("pixels", lambda p: p["r"] * w + p["c"]))).alias("_taken"), F.count("*").alias("_arcs"))
    rest = maps.join(taken, "map_id", "left").withColumn("mask", F.transform("mask", lambda x, i: F.when(F.coalesce(F.array_contains("_taken", i), F.lit(False)), 0).otherwise(x)))
    residual = token_statistics(region_cells(rest, h, w), h, w, weighted=True, radius=min(h, w) / 2).where(F.col("area") >= least).withColumn("kind", token_kind(ring=False))
    residual = residual.withColumn("_rank", F.row_number().over(Window.partitionBy("map_id").orderBy(F.round(residual_importance(), 9).desc(), "token")))
    residual = residual.join(taken.select("map_id", "_arcs"), "map_id", "left").where(F.col("_rank") <= k - F.coalesce("_arcs", F.lit(0))).drop("_rank", "_arcs")
    both = arcs.unionByName(residual.select(*arcs.columns))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("map_id").orderBy(F.round(display_order(), 9).desc(), "token")))


def votes(points: DataFrame, sigma: float) -> DataFrame:
    """Tensor voting between the points (map_id, r, c) of a map within 3 sigma: stick and ball saliency of each point.

    Points meet through tiles of that size, so only near ones are compared.
    """
    size = int(math.ceil(3 * sigma))
    tile = lambda c, d=0: F.floor(F.col(c) / size).cast("int") + d
    near = points.select("map_id", F.col("r").alias("r2"), F.col("c").alias("c2"), tile("r").alias("tr"), tile("c").alias("tc"))
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    asked = points.select("map_id", "r", "c", moves.alias("m")).select("map_id", "r", "c", (tile("r") + F.col("m.a")).alias("tr"), (tile("c") + F.col("m.b")).alias("tc"))
    d2 = (F.col("r") - F.col("r2")) ** 2 + (F.col("c") - F.col("c2")) ** 2
    pairs = asked.join(near, ["map_id", "tr", "tc"]).withColumn("d2", d2).where((F.col("d2") > 0) & (F.col("d2") <= (3 * sigma) ** 2))
    wgt = F.exp(-F.col("d2") / (sigma * sigma))
    ur, uc = (F.col("r") - F.col("r2")) / F.sqrt("d2"), (F.col("c") - F.col("c2")) / F.sqrt("d2")
    total = lambda x: F.sum(F.round(x * 2**40).cast("bigint")) / 2.0**40  # noqa: E731  whole numbers, so that the order of rows does not show
    sums = pairs.groupBy("map_id", "r", "c").agg(total(wgt).alias("s"), total(wgt * ur * ur).alias("a"), total(wgt * uc * uc).alias("b"), total(wgt * ur * uc).alias("x"))
    large, small = eigenvalues(F.col("s") - F.col("a"), F.col("s") - F.col("b"), -F.col("x"))
    return sums.select("map_id", "r", "c", (large - small).alias("stick"), small.alias("ball"))


def salient(voted: DataFrame, share: float = 0.3) -> DataFrame:
    """Points whose stick or ball saliency reaches a share of their map's largest."""
    top = voted.groupBy("map_id").agg(F.max("stick").alias("_stick"), F.max("ball").alias("_ball"))
    return voted.join(top, "map_id").where((F.col("stick") >= share * F.col("_stick")) | (F.col("ball") >= share * F.col("_ball"))).drop("_stick", "_ball")


def core_points(points: DataFrame, eps: float, min_points: int) -> DataFrame:
    """Add `near` (points within eps, itself included) and `core` to (map_id, r, c), through tiles of eps."""
    size = max(1, int(math.ceil(eps)))
    tile = lambda c: F.floor(F.col(c) / size).cast("int")
    other = points.select("map_id", F.col("r").alias("r2"), F.col("c").alias("c2"), tile("r").alias("tr"), tile("c").alias("tc"))
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    asked = points.select("map_id", "r", "c", moves.alias("m")).select("map_id", "r", "c", (tile("r") + F.col("m.a")).alias("tr"), (tile("c") + F.col("m.b")).alias("tc"))
    pairs = asked.join(other, ["map_id", "tr", "tc"]).where((F.col("r") - F.col("r2")) ** 2 + (F.col("c") - F.col("c2")) ** 2 <= eps * eps)
    return pairs.groupBy("map_id", "r", "c").agg(F.count("*").alias("near")).withColumn("core", F.col("near") >= min_points)


def dbscan(maps: DataFrame, h: int, w: int, eps: float, min_points: int) -> DataFrame:
    """map_id, r, c, cluster: core points joined within eps, border points with the smallest such cluster, others null.

    Reach is a set of grid moves, so clusters are components over those moves, worked out in the row.
    """
    reach = [(dr, dc) for dr in range(-int(eps), int(eps) + 1) for dc in range(-int(eps), int(eps) + 1) if (dr or dc) and dr * dr + dc * dc <= eps * eps]
    near = G.stencil(F.col("mask"), h, w, [(0, 0), *reach], G.total, F.lit(0))
    cored = maps.withColumn("_core", F.zip_with("mask", near, lambda m, n: ((m > 0) & (n >= min_points)).cast("int")))
    cored = S.with_components(cored.select("map_id", "mask", "_core"), "_labels", "_core", h, w, reach)
    far = h * w + 1
    beside = G.stencil(F.transform("_labels", lambda x: F.when(x > 0, x).otherwise(far)), h, w, [(0, 0), *reach], G.smallest, F.lit(far))
    cluster = F.zip_with("_labels", beside, lambda own, b: F.when(own > 0, own).when(b < far, b))
    rows = cored.select("map_id", F.posexplode(F.arrays_zip("mask", cluster.alias("cluster"))).alias("i", "x")).where("x.mask > 0")
    return rows.select("map_id", G.row_of(F.col("i"), w).alias("r"), G.column_of(F.col("i"), w).alias("c"), F.col("x.cluster").alias("cluster"))


def density_peaks(maps: DataFrame, h: int, w: int, sigma: float, support: float = 0.2, min_points: int = 3, min_mass: float = 3.0) -> DataFrame:
    """One scale of mode `sparse-density`: regions where a masked kernel density is at least a share of its peak.

    The kernel is a separable Gaussian cut at three sigma along each axis.
    """
    heat = G.blur(F.transform("counts", lambda x: x.cast("double")), h, w, sigma, edge=False)
    heated = maps.withColumn("_heat", F.zip_with(heat, "valid", lambda x, v: x * v))
    heated = heated.withColumn("_support", F.transform("_heat", lambda x: ((x > 0) & (x >= support * F.array_max("_heat"))).cast("int")))
    labelled = S.with_components(heated.select("map_id", "counts", "_support"), "_labels", "_support", h, w)
    rows = labelled.select("map_id", F.posexplode(F.arrays_zip(F.col("_labels").alias("token"), "counts")).alias("i", "x")).where("x.token > 0 AND x.counts > 0")
    cells = rows.select("map_id", F.col("x.token").alias("token"), G.row_of(F.col("i"), w).alias("r"), G.column_of(F.col("i"), w).alias("c"), F.col("x.counts").cast("double").alias("n"), F.lit(0).alias("edges"))
    own = token_statistics(cells, h, w, weighted=True, radius=min(h, w) / 2)
    return own.where((F.col("area") >= min_points) & (F.col("mass") >= min_mass)).withColumn("sigma", F.lit(sigma))


def sparse_density_tokens(maps: DataFrame, h: int, w: int, sigmas: tuple[float, ...] = (0.8, 1.6, 3.2), overlap: float = 0.6, top_k: int = 6) -> DataFrame:
    """Mode `sparse-density`: peaks of all scales, of which a token goes if a better one shares `overlap` of their pixels.

    Better means larger mass, then the finer scale, then the earlier start; a token that goes still shadows others.
    """
    maps = written(maps.select("map_id", "counts", "valid"), "maps")
    parts = [density_peaks(maps, h, w, s) for s in sigmas]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.withColumn("_order", F.row_number().over(Window.partitionBy("map_id").orderBy(F.desc("mass"), "sigma", "token")))
    every = written(every, "peaks")
    other = every.select("map_id", F.col("_order").alias("_o2"), F.col("pixels").alias("_p2"))
    shared = F.size(F.array_intersect("pixels", "_p2")) / F.size(F.array_union("pixels", "_p2"))
    shadowed = every.join(other, "map_id").where((F.col("_o2") < F.col("_order")) & (shared >= overlap)).select("map_id", "_order").distinct()
    kept = every.join(shadowed, ["map_id", "_order"], "left_anti").drop("_order").withColumn("kind", token_kind())
    return keep_top(kept, F.col("mass"), top_k)


def fragmented(maps: DataFrame, h: int, w: int, least: int = 3, share: float = 0.5) -> DataFrame:
    """map_id and whether a map is fragmented: `least` cells or more in two regions or more, the largest of them under `least` cells or at most a share of all."""
    cells = region_cells(maps, h, w).groupBy("map_id", "token").agg(F.count("*").alias("area"))
    all_cells, largest = F.sum("area"), F.max("area")
    return cells.groupBy("map_id").agg(((all_cells >= least) & (F.count("*") >= 2) & ((largest < least) | (largest <= share * all_cells))).alias("fragmented"))


#: Segmentation modes by name: (maps, h, w, valid cells) -> tokens. More can be added.
MODES = {
    "cc": cc_tokens,
    "diverse": diverse_tokens,
    "arc-ring-residual": arc_ring_residual_tokens,
    "sparse-density": lambda maps, h, w, valid: sparse_density_tokens(maps, h, w),
}


def segment(maps: DataFrame, mode: str, h: int, w: int, valid: int) -> DataFrame:
    """Tokens of every map by a mode of MODES, or by `auto`: sparse density where a map is fragmented, else connected regions."""
    if mode == "auto":
        choice = fragmented(maps, h, w)
        sparse = maps.join(choice.where("fragmented"), "map_id", "left_semi")
        whole = maps.join(choice.where("fragmented"), "map_id", "left_anti")
        return segment(sparse, "sparse-density", h, w, valid).unionByName(segment(whole, "cc", h, w, valid), allowMissingColumns=True)
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; known: auto, {', '.join(MODES)}")
    return MODES[mode](maps, h, w, valid)
