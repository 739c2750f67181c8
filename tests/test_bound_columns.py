"""What a map's loops read of its row is worked out once for the map, not again for each cell or pair of points."""

import re

import pytest
from pyspark.sql import functions as F

from gridloom.operators import cluster as C
from gridloom.operators import segment as T
from gridloom.operators import transforms as X
from gridloom.plans import adapters as A

H = W = 6


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def maps(spark):
    rows = [(m, [int((k * (m + 3)) % 7 < 3) for k in range(H * W)]) for m in range(4)]
    return spark.createDataFrame(rows, "map_id long, mask array<int>").repartition(2).withColumn("valid", F.transform("mask", lambda x: F.lit(1)))


def test_radius_is_bound(maps):
    own = C.with_radius(maps, W)
    assert re.search(r"<= lambda \w+", _plan(own.select(C.neighbours(F.col("points"), F.col("radius"), W))))
    for r in own.select("points", "radius", C.neighbours(F.col("points"), F.col("radius"), W).alias("near")).collect():
        gap = lambda a, b: ((a // W - b // W) ** 2 + (a % W - b % W) ** 2) ** 0.5
        assert r.near == [[j for j, b in enumerate(r.points) if gap(a, b) <= r.radius] for a in r.points]


def test_ring_centre_is_bound(maps):
    assert re.search(r"abs\(\(.{0,400}? - lambda \w+#\d+\)\)", _plan(T.ring_band(maps, H, W).select("band_mask")))


def test_maps_keep_their_partitions(spark, sf):
    own = A.maps(spark, sf)
    own.collect()
    assert own.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_copies_are_not_made_anew_by_a_filter(maps):
    assert not re.search(r"Filter [^\n]*array_(intersect|union)", _plan(X.changed_copies(maps, H, W, 2)))
