"""python -m roomlens.plans.cli generate | audit | score | tools | compare: the jobs over files of layouts and JSON lines."""

from __future__ import annotations

import argparse
import datetime
import functools
import importlib
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import agent, results, tools
from ..sources import layouts, records
from . import generate as G


def even(text: str) -> int:
    n = int(text)
    if n < 2 or n % 2:
        raise argparse.ArgumentTypeError("must be positive and even")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="roomlens", description=__doc__)
    sub = p.add_subparsers(dest="job", required=True)
    g = sub.add_parser("generate", help="questions with answers from layouts")
    g.add_argument("--layout-dir", required=True)
    g.add_argument("--output-dir", required=True)
    g.add_argument("--num-layouts", type=even, default=20)
    g.add_argument("--seed", type=int, default=0)
    g.add_argument("--split", choices=G.SPLITS, default="train")
    g.add_argument("--grid-resolution", type=positive, default=G.STEP, help="meters between the grid points of shortest paths")
    a = sub.add_parser("audit", help="rates of a generated corpus and their gates")
    a.add_argument("records")
    a.add_argument("--layout-dir", required=True)
    a.add_argument("--compare", help="a second run that must hold the same bytes")
    a.add_argument("--report-json")
    s = sub.add_parser("score", help="responses against their records")
    s.add_argument("records")
    s.add_argument("--layout-dir", required=True)
    s.add_argument("--sample-size", type=int)
    s.add_argument("--seed", type=int, default=0)
    s.add_argument("--output-json", required=True)
    t = sub.add_parser("tools", help="puts questions to a responder that may call tools, and scores its answers")
    t.add_argument("records")
    t.add_argument("--layout-dir", required=True)
    t.add_argument("--responder", required=True, help="module:function that takes a request and gives a reply, both dicts")
    t.add_argument("--model", default="responder")
    t.add_argument("--max-tokens", type=int, default=2500)
    t.add_argument("--max-turns", type=int, default=8)
    t.add_argument("--retries", type=int, default=2)
    t.add_argument("--seed", type=int, default=0)
    pick = t.add_mutually_exclusive_group()
    pick.add_argument("--limit", type=int)
    pick.add_argument("--question-id", action="append")
    t.add_argument("--output-json", required=True)
    c = sub.add_parser("compare", help="runs the tools behind placement and repositioning records again and compares")
    c.add_argument("--questions", required=True)
    c.add_argument("--layout-dir", required=True)
    c.add_argument("--output", required=True)
    return p


def positive(text: str) -> float:
    x = float(text)
    if not 0 < x < float("inf"):
        raise argparse.ArgumentTypeError("must be positive")
    return x


def now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat()


def _named(name: str) -> agent.Responder:
    """A responder by module:function; looked up again by each task, so that nothing of it must be sent."""
    module, _, function = name.partition(":")
    getattr(importlib.import_module(module), function)  # fails here rather than in a task
    return functools.partial(_respond, module, function)


def _respond(module: str, function: str, body: dict) -> dict:
    return getattr(importlib.import_module(module), function)(body)


def verdict(row: dict) -> str:
    """A run's summary in a line for a console."""
    return f"{row['correct']} of {row['completed']} correct ({row['score']:.1%}), " + ", ".join(f"{v} {k.replace('_', ' ')}" for k, v in row.items() if k not in ("correct", "completed", "score"))


def evaluate_tools(args: argparse.Namespace, read: DataFrame, own: DataFrame) -> dict:
    """Dialogues over the chosen questions, their scores, and the report."""
    began = now()
    questions = results.selected(read, args.limit, args.question_id)
    said = agent.ask_all(questions, own, agent.with_retries(_named(args.responder), args.retries), args.model, args.seed, args.max_tokens, args.max_turns).cache()
    graded = G.score(questions.drop("response").join(said.select("id", "response"), "id"), own)
    runs = said.withColumnRenamed("error", "failure").join(graded.drop("task", "error"), "id").withColumn("error", F.col("failure")).withColumn("correct", F.col("correct") & F.col("failure").isNull()).cache()
    summary = results.agent_summary(runs).first().asDict()
    print(verdict(summary))
    source = questions.withColumn("source", F.element_at(F.split("source_layout", "/"), -2))
    records.write_lines(runs.where("not correct").select("id", "task", "parsed", "error"), f"{args.output_json}.failed", ("id",), "overwrite")
    return {
        "configuration": {k: v for k, v in vars(args).items() if k != "job"}, "started_at": began, "finished_at": now(), "summary": summary,
        "by_task": [r.asDict() for r in results.by_task(runs).orderBy("task").collect()], "tool_usage": {r.tool: r.n for r in results.usage(runs).orderBy("tool").collect()},
        "selected": [r.asDict() for r in results.distributions(source, "task", "source").orderBy("what", "value").collect()], "failed_ids": f"{args.output_json}.failed",
    }


def compare(read: DataFrame, own: DataFrame) -> DataFrame:
    """results.snapshot of what the tools say now and what placement and repositioning records hold."""
    of = lambda k: F.get_json_object("parameters", f"$.{k}")
    file = F.element_at(F.split("source_layout", "/"), -1)
    place = F.to_json(F.struct(of("object_width").cast("double").alias("width"), of("object_depth").cast("double").alias("length"), file.alias("file_id")))
    move = F.to_json(F.struct(of("object_to_move").alias("object_id"), of("direction").alias("direction"), file.alias("file_id")))
    calls = read.where(F.col("task").isin("placement", "repositioning")).select(
        F.col("id").alias("call_id"), F.when(F.col("task") == "placement", "find_space_with_size").otherwise("test_movement").alias("tool"), F.when(F.col("task") == "placement", place).otherwise(move).alias("arguments"),
        F.when(F.col("reference_answer") == "true", 1.0).when(F.col("reference_answer") == "false", 0.0).otherwise(F.col("reference_answer").try_cast("double")).alias("theirs"),
    )
    ours = F.when(F.col("tool") == "test_movement", text.tool_distance(F.col("output"))).otherwise(text.tool_status(F.col("output")).cast("double"))
    said = tools.tool_calls(calls.drop("theirs"), own).select("call_id", ours.alias("ours"))
    return results.snapshot(calls.join(said, "call_id"))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("roomlens").getOrCreate()
    own = layouts.read_layouts(spark, args.layout_dir).where("error is null").drop("error")
    if args.job == "generate":
        made, report = G.generate(own, args.num_layouts, args.seed, args.split, step=args.grid_resolution)
        records.write_lines(made, f"{args.output_dir}/{args.split}", ("id",))
        records.write_layouts(own.join(made.select(F.col("source_layout").alias("layout_key")).distinct(), "layout_key", "left_semi"), f"{args.output_dir}/layouts", args.split)
        counts = {r.task: r.n for r in results.task_counts(made).collect()}
        records.write_report(f"{args.output_dir}/{args.split}-report.json", report | {"tasks": counts, "seed": args.seed, "split": args.split, "generated_at": now()})
        return 0
    lines = records.read_lines(spark, args.questions if args.job == "compare" else args.records)
    read = lines.select("line_number", F.from_json("value", f"{G.RECORD}, response string").alias("r")).select("line_number", "r.*")
    if args.job == "tools":
        records.write_report(args.output_json, evaluate_tools(args, read, own))
        return 0
    if args.job == "compare":
        found = {r.tool: r.asDict() for r in compare(read, own).collect()}
        records.write_report(args.output, {"tools": found, "compared_at": now()})
        return int(any(r["matches"] < r["calls"] for r in found.values()))
    read = read.drop("line_number")
    if args.job == "audit":
        found = {r.metric: r.value for r in G.audit(read.drop("response"), own).collect()}
        if args.compare:
            found["deterministic_match_rate"] = float(records.same_bytes(spark, args.records, args.compare))
        missed = {k: v for k, v in found.items() if v < results.GATES.get(k, 0.0)}
        report = {"metrics": found, "missed": missed}
        if args.report_json:
            records.write_report(args.report_json, report)
        print("\n".join(f"{k}: {v:.4f}{'  MISSED' if k in missed else ''}" for k, v in sorted(found.items())))
        return int(bool(missed))
    if args.sample_size is not None:
        if not 1 <= args.sample_size <= read.count():
            raise SystemExit("--sample-size must be positive and at most the number of examples")
        read = read.orderBy(F.sha2(F.concat_ws(":", F.lit(str(args.seed)), "id"), 256)).limit(args.sample_size)
    scored = G.score(read, own).cache()
    done = scored.select("task", "correct", "parsed", "error", F.lit(0).alias("tokens"), F.lit(0.0).alias("duration"))
    records.write_lines(scored.where("not correct"), f"{args.output_json}.failed", ("id",), "overwrite")
    source = read.withColumn("source", F.element_at(F.split("source_layout", "/"), -2))
    report = {
        "summary": results.run_summary(done).first().asDict(), "by_task": [r.asDict() for r in results.by_task(done).orderBy("task").collect()],
        "selected": [r.asDict() for r in results.distributions(source, "task", "source").orderBy("what", "value").collect()], "failed_ids": f"{args.output_json}.failed", "finished_at": now(),
    }
    records.write_report(args.output_json, report)
    return 0


if __name__ == "__main__":
    sys.exit(main())
