"""Records and reports in files: JSON lines in and out, layout files, one-file reports."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a line of questions may hold; nested values stay JSON text.
LINE = "id string, task string, layout_id string, room_type string, split string, layout_file string, source_layout string, question string, input string, prompt string, answer string, parameters string, reference_answer string, provenance string, messages array<struct<role:string,content:string>>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_number (from 1, blank lines counted), value and file of each line that isn't blank.

    A file is read whole, since only so its physical line numbers are known.
    """
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    lines = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("at", "value"))
    return lines.where(F.trim("value") != "").select((F.col("at") + 1).alias("line_number"), "value", "file")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Lines as examples; ``error`` says what is wrong with one: no JSON object, no input, or no answer."""
    lines = read_lines(spark, path)
    r = lines.select("line_number", F.from_json("value", LINE + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    x = r.select("line_number", "r.*")
    usable = F.filter("messages", lambda m: m["role"].isin("system", "user") & m["content"].isNotNull())
    asked = F.filter(F.array("question", "input", "prompt"), lambda v: F.trim(v) != "")
    given = F.when(F.exists(usable, lambda m: m["role"] == "user"), usable).when(F.size(asked) > 0, F.array(F.struct(F.lit("user").alias("role"), F.get(asked, F.lit(0)).alias("content"))))
    x = x.withColumn("messages", given)
    error = F.when(F.col("_bad").isNotNull(), "not a JSON object").when(F.col("messages").isNull(), "no user input").when(F.col("answer").isNull(), "missing answer")
    return x.withColumns({
        "error": error, "id": F.coalesce("id", F.concat(F.lit("line-"), F.col("line_number").cast("string"))), "task": F.coalesce("task", F.lit("")), "answer": F.trim("answer"),
        "reference_answer": F.coalesce("reference_answer", "answer"), "parameters": F.coalesce("parameters", F.lit("{}")),
    }).drop("_bad")


def write_lines(records: DataFrame, path: str, order_by: tuple[str, ...] = (), mode: str = "error") -> None:
    """A folder of JSON-line files, in order of ``order_by`` across and inside files. ``mode``: what to do if it exists."""
    (records.orderBy(*order_by) if order_by else records).write.mode(mode).json(path, ignoreNullFields=False)


def write_layouts(layouts: DataFrame, path: str, split: str) -> None:
    """JSON text of each layout, in a folder per group that read_layouts reads again."""
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    points = lambda c: F.transform(c, point)
    section = lambda s: F.transform(F.filter("entities", lambda e: e["section"] == s), lambda e: F.struct(e["label"].alias("label"), points(e["ring"]).alias("points")))
    body = F.to_json(F.struct("layout_id", "room_type", points(F.col("room")).alias("room_boundary"), section("objects").alias("objects"), F.struct(section("doors").alias("doors"), section("windows").alias("windows")).alias("openings")))
    rows = layouts.select("source_group", F.concat_ws("-", "source_group", "layout_id", F.lit(split)).alias("name"), body.alias("body"))

    # written by the driver as they come, since executors have disks of their own; as many as were asked for
    for row in rows.toLocalIterator():
        os.makedirs(f"{path}/{row['source_group']}", exist_ok=True)
        write_report(f"{path}/{row['source_group']}/{row['name']}.json", json.loads(row["body"]))


def write_report(path: str, report: dict) -> None:
    """One indented JSON file, whole or not at all; not-a-number values are refused."""
    text = json.dumps(report, indent=2, ensure_ascii=False, allow_nan=False)
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(text + "\n")
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def same_bytes(spark: SparkSession, a: str, b: str) -> bool:
    """Whether two files, or the files of two folders in order of name, hold the same."""
    sums = [[r["h"] for r in spark.read.format("binaryFile").load(p).select("path", F.sha2("content", 256).alias("h")).orderBy("path").collect()] for p in (a, b)]
    return sums[0] == sums[1]


def natural_key(name):
    """Orders names with runs of digits as numbers: a run is led by how many digits it has, leading zeros left out."""
    digits = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 5, "0"), digits(p))).otherwise(p)), "")
