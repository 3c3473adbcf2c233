"""Joins that survive keys holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from 1 / HOT of all rows on, if that is LEAST rows at least; rows that the shuffled join must not match are spread over SPREAD keys.
HOT, LEAST, SPREAD = 128, 10_000, 4096


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], sizes: DataFrame, how: str = "inner", hot: int = HOT) -> DataFrame:
    """Join many-row ``left`` with ``right``, which has one row per key.

    ``sizes`` has ``keys`` and ``n``, the rows of ``left`` per key. A key with more
    than 1/``hot`` of all rows is hot; there can be at most ``hot`` of them, which
    is the proven bound of what is broadcast. All other keys are joined by shuffle, in
    which rows of hot and of NULL keys carry a salt that matches nothing and spreads
    them. ``how`` is inner or left; the other columns of ``right`` must not be in ``left``.
    """
    missing = F.lit(False)
    for k in keys:
        missing |= F.col(k).isNull()
    total = sizes.agg(F.sum("n")).first()[0] or 0
    keys_hot = [tuple(r) for r in sizes.where((F.col("n") > max(total / hot, LEAST)) & ~missing).select(*keys).collect()]
    values, out = [c for c in right.columns if c not in keys], left.columns
    if not keys_hot and how == "inner":
        return left.join(right, keys).select(*out, *values)
    salted, is_hot = left, F.lit(False)
    if keys_hot:
        hot_df = F.broadcast(left.sparkSession.createDataFrame(keys_hot, sizes.select(*keys).schema))
        small = right.join(hot_df, keys, "left_semi").select(*keys, F.struct(*values).alias("_hot_row"))
        small = hot_df.join(F.broadcast(small), keys, "left").withColumn("_hot", F.lit(True))
        salted, is_hot = left.join(F.broadcast(small), keys, "left"), F.col("_hot").isNotNull()
    salted = salted.withColumn("_salt", F.when(is_hot | missing, F.pmod(F.xxhash64(*out), F.lit(SPREAD)) + 1).otherwise(0))
    r = right.select(*keys, F.lit(0).cast("bigint").alias("_salt"), F.struct(*values).alias("_row"))
    joined = salted.join(r, [*keys, "_salt"], "left")
    row = F.coalesce(F.col("_hot_row"), F.col("_row")) if keys_hot else F.col("_row")
    joined = joined.select(*out, row.alias("_row"))
    if how == "inner":
        joined = joined.where("_row is not null")
    return joined.select(*out, *[F.col("_row").getField(c).alias(c) for c in values])
