"""Rooms and their entities derived from the order tables, for engines that have no floor plans at hand.

One room per order, one entity per line item. Coordinates are tenths of a metre, so that every engine computes the same doubles. The
same derivation in SQL is ``LAYOUT_SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GROUPS = ("bedroom", "hssd", "kitchen", "living_room")
TYPES = ("chair", "table", "bed", "desk", "sofa", "rug", "ceiling light", "fridge", "plant", "wardrobe", "stove", "bookshelf")
#: Order of the line items of a room; unique, as (order, line number) is not.
NUMBERED_BY = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
SOFT = "(?i)rug|carpet|mat|doormat|runner"
CEILING = "(?i)light|chandelier|fan|pendant"


def _pick(values: tuple[str, ...], n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """room_id, source_group, room_w, room_h: the room is the rectangle from (0, 0)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("room_id"), _pick(GROUPS, key).alias("source_group"),
        ((F.col("o_custkey") % 40 + 50) / F.lit(10.0)).alias("room_w"), ((key % 30 + 45) / F.lit(10.0)).alias("room_h"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """room_id, seq (from 1), label, type, kind, x1, y1, x2, y2, and the label classes is_soft and is_ceiling."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_discount", "l_tax", *NUMBERED_BY)
    line = line.withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*NUMBERED_BY)))
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    x, y = part % 60, supp % 45
    w, h = F.floor(F.col("l_discount") * 100 + 0.5) * 2 + 4, F.floor(F.col("l_tax") * 100 + 0.5) + 4
    kind = F.when(supp % 10 == 0, "door").when(supp % 10 == 1, "window").otherwise("object")
    kinds = F.when(kind == "object", _pick(TYPES, part)).otherwise(kind)
    e = line.select(
        F.col("l_orderkey").alias("room_id"), "seq", F.concat(kinds, F.lit("_"), F.col("seq").cast("string")).alias("label"), kinds.alias("type"), kind.alias("kind"),
        (x / F.lit(10.0)).alias("x1"), (y / F.lit(10.0)).alias("y1"), ((x + w) / F.lit(10.0)).alias("x2"), ((y + h) / F.lit(10.0)).alias("y2"),
    )
    return e.withColumns({"is_soft": F.col("label").rlike(SOFT), "is_ceiling": F.col("label").rlike(CEILING)})


def _sql_list(values: tuple[str, ...], n: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({n}) % {len(values)} + 1]"


LAYOUT_SQL = f"""
rooms AS (SELECT o_orderkey AS room_id, {_sql_list(GROUPS, "o_orderkey")} AS source_group,
                 (o_custkey % 40 + 50) / 10.0::double AS room_w, (o_orderkey % 30 + 45) / 10.0::double AS room_h FROM orders),
line AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(NUMBERED_BY)})::int AS seq,
                CASE l_suppkey % 10 WHEN 0 THEN 'door' WHEN 1 THEN 'window' ELSE 'object' END AS kind,
                floor(l_discount * 100 + 0.5) * 2 + 4 AS w, floor(l_tax * 100 + 0.5) + 4 AS h FROM lineitem),
typed AS (SELECT *, CASE kind WHEN 'object' THEN {_sql_list(TYPES, "l_partkey")} ELSE kind END AS type FROM line),
entities AS (SELECT *, regexp_matches(label, '{SOFT}') AS is_soft, regexp_matches(label, '{CEILING}') AS is_ceiling
             FROM (SELECT l_orderkey AS room_id, seq, type || '_' || seq AS label, type, kind,
                          l_partkey % 60 / 10.0::double AS x1, l_suppkey % 45 / 10.0::double AS y1,
                          (l_partkey % 60 + w) / 10.0::double AS x2, (l_suppkey % 45 + h) / 10.0::double AS y2 FROM typed))"""
