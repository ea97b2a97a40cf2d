"""Deterministic choices: ranks by a hash of seed and key take the place of a shuffled list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key(seed: int, *parts: Column | str) -> Column:
    """Hex SHA-256 of ``seed:part:part``; strings are literals."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def layout_sample(layouts: DataFrame, id_column: str, n: int, seed: int) -> DataFrame:
    """``n`` layouts in seeded order, with their rank from 1. The rank's window sees no more than the n rows that were taken."""
    taken = layouts.withColumn("rank_key", key(seed, "layout-order", F.col(id_column))).orderBy("rank_key").limit(n)
    return taken.withColumn("rank", F.row_number().over(Window.orderBy("rank_key"))).drop("rank_key")


def boolean_schedule(sample: DataFrame, id_column: str, task: str, seed: int) -> DataFrame:
    """A target for each of a bounded, even sample: half False, half True, dealt by hash."""
    ranked = sample.withColumn("k", F.row_number().over(Window.orderBy(key(seed, "boolean-answers", task, F.col(id_column)))))
    n = sample.count()
    if n % 2:
        raise ValueError("a balanced schedule needs an even number of layouts")
    return ranked.withColumn("target", F.col("k") > n // 2).drop("k")


def pair_choice(entities: DataFrame, group: str, item: str, task: str, seed: int) -> DataFrame:
    """Two distinct items of each group, in order: those of lowest hash."""
    own = key(seed, F.col(group), task, F.col(item))
    ranked = entities.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(own, item))).where("k <= 2")
    both = ranked.groupBy(group).agg(F.max(F.when(F.col("k") == 1, F.col(item))).alias("object_1"), F.max(F.when(F.col("k") == 2, F.col(item))).alias("object_2"))
    return both.where("object_2 is not null")
