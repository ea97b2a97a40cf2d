"""Queries that need the geometry kernel, over the rooms of the driver tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import relations, results
from ..operators.kernel import frechet
from ..operators.layout import Layout
from ..operators.tools import tool_calls
from ..sources.driver_tables import LAYOUT_SQL, entities, rooms
from ..sources.layouts import nested
from . import kernel_oracles
from .generate import _rows_of, audit, generate, records_of_all, task_answers

SEED = kernel_oracles.SEED


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested(rooms(spark, sf_dir), entities(spark, sf_dir))


def keys_and_pick(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The keys of all layouts, and what nests the layouts of a few keys without nesting the others."""
    r, e = rooms(spark, sf_dir), entities(spark, sf_dir)
    key = F.concat_ws("/", "source_group", F.concat(F.col("room_id").cast("string"), F.lit(".json"))).alias("layout_key")
    held = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("room_id")).distinct()

    def pick(few: DataFrame) -> DataFrame:
        ids = F.broadcast(few.select(_room_id()))
        return nested(r.join(ids, "room_id", "left_semi"), e.join(ids, "room_id", "left_semi"))

    return r.join(held, "room_id", "left_semi").select(key), pick


def _asked(task: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: task_answers(layouts(spark, sf_dir), task, SEED)


def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair asked about in each valid room, and what lies between as a JSON list."""
    a = task_answers(layouts(spark, sf_dir), "visibility", SEED).where("error is null")
    return a.select(_room_id(), *(F.get_json_object("parameters", f"$.{k}").alias(k) for k in ("object_1", "object_2")), F.col("value").alias("hits"))


def repositioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object and direction asked about in each valid room, and how far it gets, as text."""
    a = task_answers(layouts(spark, sf_dir), "repositioning", SEED).where("error is null")
    return a.select(_room_id(), *(F.get_json_object("parameters", f"$.{k}").alias(k) for k in ("object_to_move", "direction")), F.col("value").alias("distance"))


def _room_id():
    return F.regexp_extract("layout_key", r"(\d+)\.json$", 1).cast("long").alias("room_id")


def largest_empty_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(row: dict) -> Iterator[dict]:
        yield {"room_id": int(row["layout_id"]), "area": round(float(Layout(row).largest_box()[0]), 6)}

    return _rows_of(layouts(spark, sf_dir), make, "room_id long, area double")


def curve_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discrete Frechet distance between the two halves of each vector, read as paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                points = list(zip(v[::2], v[1::2], strict=True)) if v else []
                out.append(round(frechet(points[: len(points) // 2], points[len(points) // 2 :]), 6))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["vec_id", "distance"])

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>"))
    return e.mapInArrow(run, "vec_id long, distance double")


def tool_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What seven tools say: of every room, of its entities, and of those that follow each other in its list."""
    own, valid = layouts(spark, sf_dir), relations.validation(rooms(spark, sf_dir), entities(spark, sf_dir)).where("valid").select(F.col("room_id").cast("string").alias("layout_id"))
    ask = lambda tool, ids=(), **args: F.struct(F.concat_ws("/", "layout_id", F.lit(tool), *ids).alias("call_id"), F.lit(tool).alias("tool"), F.to_json(F.struct(*(c.alias(k) for k, c in args.items()))).alias("arguments"))
    file = F.concat("layout_id", F.lit(".json"))
    far = F.get(F.get("room", F.lit(2)), F.lit(0)), F.get(F.get("room", F.lit(2)), F.lit(1))
    whole = F.array(ask("inspect_room", file_id=file), ask("calculator", operand_1=far[0], operand_2=far[1], operator=F.lit("mul")))
    each = F.transform("entities", lambda e: ask("inspect_entity", (e["label"],), object_id=e["label"], file_id=file))
    labels = F.transform("entities", lambda e: e["label"])
    ends = F.arrays_zip(F.slice(labels, 1, F.size(labels) - 1).alias("a"), F.slice(labels, 2, F.size(labels)).alias("b"))
    of_two = lambda tool: F.transform(ends, lambda p: ask(tool, (p["a"], p["b"]), object_id_1=p["a"], object_id_2=p["b"], file_id=file))
    calls = own.select("layout_id", F.explode(F.concat(whole, each, *map(of_two, ("pair_distance", "view_angle", "ray_trace")))).alias("c"))
    calls = calls.unionByName(own.join(valid, "layout_id", "left_semi").select("layout_id", ask("occupied_floor_area", file_id=file).alias("c")))
    return tool_calls(calls.select("c.*"), own)


def tool_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movement sentences of all valid rooms' movable objects, in all directions, against the closed form, and how each catalog item's placement is judged.

    What fits along the axes must fit for the tool; what doesn't may fit turned or stay open: n_one_sided counts these apart from matches.
    """
    r, e = rooms(spark, sf_dir), entities(spark, sf_dir)
    valid = relations.validation(r, e).where("valid").join(relations.duplicate_labels(e, "label").select("room_id").distinct(), "room_id", "left_anti").select("room_id")
    # read six times below; on disk, as it grows with the tables
    r, e = (df.join(valid, "room_id", "left_semi").persist(StorageLevel.DISK_ONLY) for df in (r, e))
    file = F.concat(F.col("room_id").cast("string"), F.lit(".json")).alias("file_id")
    asked = lambda df, tool, ids, args, theirs: df.select(F.concat_ws("/", "room_id", *ids).alias("call_id"), F.lit(tool).alias("tool"), F.to_json(F.struct(*args, file)).alias("arguments"), theirs.cast("double").alias("theirs"))
    moves = asked(relations.slide_distance(r, e), "test_movement", ("label", "direction"), (F.col("label").alias("object_id"), "direction"), F.col("distance"))
    sizes = relations.catalog(spark).groupBy("item").agg(F.max("width").alias("width"), F.max("depth").alias("length"))
    fits = asked(relations.placement_axis_aligned(r, e).join(F.broadcast(sizes), "item"), "find_space_with_size", ("item",), ("width", "length"), F.col("fits"))
    said = F.coalesce(text.tool_status(F.col("output")).cast("double"), F.when(F.col("tool") == "test_movement", text.tool_distance(F.col("output"))))
    both = tool_calls(moves.unionByName(fits), nested(r, e)).select("tool", said.alias("ours"), "theirs")
    one_sided = (F.col("tool") == "find_space_with_size") & (F.col("theirs") == 0) & (F.col("ours").isNull() | (F.col("ours") == 1))
    return results.snapshot(both, F.count_if(F.coalesce(one_sided, F.lit(False))).alias("n_one_sided"))


def question_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of 100 layouts, as many as are asked for."""
    keys, pick = keys_and_pick(spark, sf_dir)
    return generate(keys, 100, SEED, pick=pick)[0].select("id", "task", "parameters", "answer", "reference_answer")


def audit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over the records of all rooms."""
    own = layouts(spark, sf_dir)
    return audit(records_of_all(own, SEED), own, every=True)


def generation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over the records of 20 generated layouts, as many as are asked for."""
    keys, pick = keys_and_pick(spark, sf_dir)
    made = generate(keys, 20, SEED, pick=pick)[0].cache()
    return audit(made, pick(made.select(F.col("source_layout").alias("layout_key")).distinct()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "largest_empty_box": largest_empty_box,
    "max_box": _asked("max_box"),
    "placement_any_rotation": _asked("placement"),
    "shortest_path": _asked("shortest_path"),
    "repositioning": repositioning,
    "visibility": visibility,
    "curve_distance": curve_distance,
    "tool_outputs": tool_outputs,
    "tool_snapshot": tool_snapshot,
    "question_generation": question_generation,
    "audit_metrics": audit_metrics,
    "generation_checks": generation_checks,
}

ORACLES: dict[str, str] = {
    "largest_empty_box": f"""WITH {LAYOUT_SQL.strip()},
k AS (SELECT room_id, x1, y1, x2, y2 FROM entities WHERE NOT is_soft AND NOT is_ceiling),
held AS (SELECT * FROM rooms WHERE room_id IN (SELECT room_id FROM entities)),
xs AS (SELECT room_id, 0.0::double AS x FROM held UNION SELECT room_id, room_w FROM held UNION SELECT h.room_id, least(x1, room_w) FROM k JOIN held h USING (room_id) UNION SELECT h.room_id, least(x2, room_w) FROM k JOIN held h USING (room_id)),
ys AS (SELECT room_id, 0.0::double AS y FROM held UNION SELECT room_id, room_h FROM held UNION SELECT h.room_id, least(y1, room_h) FROM k JOIN held h USING (room_id) UNION SELECT h.room_id, least(y2, room_h) FROM k JOIN held h USING (room_id)),
gx AS (SELECT a.room_id, a.x AS l, b.x AS r FROM xs a JOIN xs b ON a.room_id = b.room_id AND a.x < b.x),
gy AS (SELECT a.room_id, a.y AS d, b.y AS u FROM ys a JOIN ys b ON a.room_id = b.room_id AND a.y < b.y),
box AS (SELECT * FROM gx JOIN gy USING (room_id)),
free AS (SELECT * FROM box WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.room_id = box.room_id AND k.x1 < r AND k.x2 > l AND k.y1 < u AND k.y2 > d))
SELECT held.room_id, round(coalesce(max((r - l) * (u - d)), 0), 6) AS area FROM held LEFT JOIN free ON free.room_id = held.room_id GROUP BY held.room_id""",
} | kernel_oracles.ORACLES
