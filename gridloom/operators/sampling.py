"""Splits, query samples and candidate pools.

Where rows are to be drawn at random they are taken in hash order, so a draw is the same on every run and cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import jaccard


def hash_order(column: str, seed: int) -> Column:
    """A mixed order of ids by plain arithmetic, within 64 bits for any id."""
    return (F.pmod(column, F.lit(2147483648)) * 2654435761 + seed) % 4294967296


def numbered(rows: DataFrame, order: list, bucket: Column, name: str) -> DataFrame:
    """Add `name`: 1, 2, 3 ... in `order` over all rows, without a window over all of them.

    `bucket` must not fall where `order` rises. Rows are numbered within buckets; a running sum over the buckets' counts,
    one row a bucket, gives where each begins.
    """
    dealt = rows.withColumn("_bucket", bucket)
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin"))
    placed = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    return placed.join(begins, "_bucket").withColumn(name, (F.col("_begin") + F.col("_at")).cast("bigint")).drop("_bucket", "_begin", "_at")


def split_sizes(n: Column, train: float = 0.7, val: float = 0.1) -> tuple[Column, Column]:
    """Training and validation sizes of a group of n; the rest is the test part.

    Sizes are floored; from three rows on each part has one at least, and training gives way first.
    """
    a, b = F.floor(n * train), F.floor(n * val)
    a, b = F.when(n >= 3, F.greatest(a, F.lit(1))).otherwise(a), F.when(n >= 3, F.greatest(b, F.lit(1))).otherwise(b)
    over = F.when(n >= 3, F.greatest(a + b + 1 - n, F.lit(0))).otherwise(F.lit(0))
    taken = F.least(over, F.greatest(a - 1, F.lit(0)))
    return (a - taken).cast("bigint"), (b - (over - taken)).cast("bigint")


def stratified_split(rows: DataFrame, group: str, key: str, seed: int, train: float = 0.7, val: float = 0.1) -> DataFrame:
    """Add split: train, val or test within each group, in hash order."""
    own = Window.partitionBy(group)
    a, b = split_sizes(F.col("_n"), train, val)
    placed = rows.withColumn("_n", F.count("*").over(own)).withColumn("_at", F.row_number().over(own.orderBy(hash_order(key, seed), key)))
    return placed.withColumn("split", F.when(F.col("_at") <= a, "train").when(F.col("_at") <= a + b, "val").otherwise("test")).drop("_n", "_at")


def older_split(rows: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """Add split: 80/10/10 for groups of ten or more; of smaller ones the last two are val and test; under three all train."""
    own = Window.partitionBy(group)
    placed = rows.withColumn("_n", F.count("*").over(own)).withColumn("_at", F.row_number().over(own.orderBy(hash_order(key, seed), key)))
    n, k = F.col("_n"), F.col("_at")
    a, b = F.floor(n * 0.8), F.floor(n * 0.1)
    large = F.when(k <= a, "train").when(k <= a + b, "val").otherwise("test")
    small = F.when(k == n - 1, "val").when(k == n, "test").otherwise("train")
    return placed.withColumn("split", F.when(n >= 10, large).when(n >= 3, small).otherwise("train")).drop("_n", "_at")


def round_robin(rows: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows, taken one from each group in turn; groups by name, rows of a group in hash order."""
    turn = Window.partitionBy(group).orderBy(hash_order(key, seed), key)
    return rows.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= n).orderBy("_turn", group, key).limit(n).drop("_turn")


#: Jaccard buckets of a candidate pool, and how many rows each gives.
BUCKETS = (("exact", 50), ("high", 100), ("low", 100), ("none", 750))


def bucket(jaccard: Column) -> Column:
    return F.when(jaccard >= 1.0, "exact").when(jaccard >= 0.5, "high").when(jaccard > 0, "low").otherwise("none")


def candidate_pools(pairs: DataFrame, total: int, quotas: tuple[tuple[str, int], ...] = BUCKETS, seed: int = 0) -> DataFrame:
    """query_id, candidate_id, jaccard, bucket: quotas by bucket in hash order, filled up in bucket order, cut at total.

    pairs: query_id, candidate_id, jaccard.
    """
    order = {name: k for k, (name, _) in enumerate(quotas)}
    quota, rank = F.lit(0), F.lit(len(order))
    for name, n in quotas:
        quota, rank = F.when(F.col("bucket") == name, n).otherwise(quota), F.when(F.col("bucket") == name, order[name]).otherwise(rank)
    tagged = pairs.withColumn("bucket", bucket(F.col("jaccard")))
    mixed = hash_order("candidate_id", seed)
    placed = tagged.withColumn("_at", F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy(mixed, "candidate_id")))
    placed = placed.withColumn("_fill", (F.col("_at") > quota).cast("int")).withColumn("_bucket", rank)
    turn = Window.partitionBy("query_id").orderBy("_fill", "_bucket", "_at")
    return placed.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= total).select("query_id", "candidate_id", "jaccard", "bucket")


def label_set_pools(queries: DataFrame, labels: DataFrame, total: int, quotas: tuple[tuple[str, int], ...] = BUCKETS, seed: int = 0) -> DataFrame:
    """`candidate_pools` of queries among all other rows of `labels`, both (id, labels), without a row for each pair.

    Queries with the same labels put all candidates into the same buckets in the same hash order, and each leaves out
    itself only. So of each set of labels the first total + 1 rows, of those the first total + 1 of each bucket of each asking
    set, hold whatever a query may take.
    """
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(hash_order("candidate_id", seed), "candidate_id"))
    rows = labels.select(F.col("id").alias("candidate_id"), F.col("labels").alias("c_labels"))
    heads = rows.withColumn("_at", first("c_labels")).where(F.col("_at") <= total + 1).drop("_at")
    asked = queries.select(F.col("labels").alias("q_labels")).distinct()
    near = asked.join(F.broadcast(rows.select("c_labels").distinct())).withColumn("jaccard", jaccard(F.col("q_labels"), F.col("c_labels"))).withColumn("_of", bucket(F.col("jaccard")))
    held = near.join(heads, "c_labels").withColumn("_at", first("q_labels", "_of")).where(F.col("_at") <= total + 1).select("q_labels", "candidate_id", "jaccard")
    own = queries.select(F.col("id").alias("query_id"), F.col("labels").alias("q_labels"))
    return candidate_pools(own.join(held, "q_labels").where("query_id <> candidate_id").drop("q_labels"), total, quotas, seed)


def first_of_other_classes(queries: DataFrame, rows: DataFrame, key: str, group: str, n: int, seed: int) -> DataFrame:
    """query_id, candidate_id and `group` of the first n rows in hash order of each group but the query's own."""
    turn = Window.partitionBy(group).orderBy(hash_order(key, seed), key)
    heads = rows.withColumn("_at", F.row_number().over(turn)).where(F.col("_at") <= n).select(F.col(key).alias("candidate_id"), group)
    return queries.select(F.col(key).alias("query_id"), F.col(group).alias("_own")).join(F.broadcast(heads), F.col("_own") != F.col(group)).drop("_own")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Add weight: one over the size of the row's class."""
    return rows.join(rows.groupBy(label).agg((1.0 / F.count("*")).alias("weight")), label)


def weighted_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows drawn without replacement in proportion to weight: the smallest -ln(u) / weight, u from the id's hash."""
    u = (hash_order(key, seed) + 1) / 4294967297.0
    return rows.withColumn("_e", -F.log(u) / F.col("weight")).orderBy("_e", key).limit(n).drop("_e")
