"""Summaries of scored runs and of generated records, and the gates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The eight tasks, and the least rates that a corpus must reach.
TASKS = ("pair_distance", "free_space", "view_angle", "repositioning", "max_box", "placement", "shortest_path", "visibility")
GATES = {
    "complete_layout_yield": 0.95, "layout_completeness_rate": 1.0, "schema_validity_rate": 1.0, "prompt_validity_rate": 1.0, "reference_reproducibility_rate": 1.0,
    "geometry_witness_validity_rate": 1.0, "placement_certification_rate": 1.0, "path_validity_rate": 1.0, "max_box_convergence_rate": 1.0,
    "deterministic_match_rate": 1.0, "boolean_answer_balance_rate": 1.0,
}


def rate(passed: Column, total: Column) -> Column:
    """0 where there is nothing to pass."""
    return F.coalesce(F.try_divide(passed.cast("double"), total.cast("double")), F.lit(0.0))


def task_counts(records: DataFrame) -> DataFrame:
    """Records per task; tasks without any have zero."""
    names = records.sparkSession.createDataFrame([(t,) for t in TASKS], "task string")
    counted = records.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counted, "task", "left").select("task", F.coalesce("n", F.lit(0)).alias("n"))


def boolean_counts(records: DataFrame, by: str, answer: Column) -> DataFrame:
    return records.groupBy(by).agg(F.count_if(answer).alias("n_true"), F.count_if(~answer).alias("n_false"))


def run_summary(results: DataFrame) -> DataFrame:
    """Columns task, correct, parsed, error, tokens, duration. One row: how a run went."""
    failed = F.col("parsed").isNull() & F.col("error").isNull()
    n = F.count(F.lit(1))
    return results.agg(
        n.alias("completed"), F.count_if("correct").alias("correct"), F.round(rate(F.count_if("correct"), n), 6).alias("score"), F.count_if(failed).alias("formatting_failures"),
        F.count("error").alias("errors"), F.sum("tokens").alias("tokens"), F.round(F.sum("duration"), 4).alias("duration"),
    )


def by_task(results: DataFrame) -> DataFrame:
    failed = F.col("parsed").isNull() & F.col("error").isNull()
    return results.groupBy("task").agg(F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("formatting_failures"), F.count("error").alias("errors"))


def usage(runs: DataFrame, trace: str = "tool_trace") -> DataFrame:
    """How often each tool was called; ``trace``: an array of calls (structs with a tool) per run."""
    return runs.select(F.explode(F.transform(trace, lambda c: c["tool"])).alias("tool")).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


def agent_summary(runs: DataFrame) -> DataFrame:
    """Columns correct, error, generated_tokens, model_calls and tool_trace. One row: how runs with tools went."""
    n = F.count(F.lit(1))
    return runs.agg(
        n.alias("completed"), F.count_if("correct").alias("correct"), F.round(rate(F.count_if("correct"), n), 6).alias("score"), F.count("error").alias("errors"),
        F.coalesce(F.sum("generated_tokens"), F.lit(0)).alias("generated_tokens"), F.coalesce(F.sum("model_calls"), F.lit(0)).alias("model_calls"), F.coalesce(F.sum(F.greatest(F.size("tool_trace"), F.lit(0)).cast("long")), F.lit(0)).alias("tool_calls"),
    )


def distributions(examples: DataFrame, *of: str) -> DataFrame:
    """(what, value, n): how often each value of the columns ``of`` stands among the examples."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in of)))
    return examples.select(each.alias("x")).groupBy("x.what", "x.value").agg(F.count(F.lit(1)).alias("n"))


def source_counts(records: DataFrame, source: str, layout: str) -> DataFrame:
    """Layouts with records, by source."""
    return records.groupBy(source).agg(F.countDistinct(layout).alias("layouts"))


def selected(examples: DataFrame, limit: int | None = None, ids: list[str] | None = None) -> DataFrame:
    """The first ``limit`` examples by line_number, or those of ``ids``, in order of the file; with neither, all. Both, or an unknown id, is an error."""
    if limit is not None and ids is not None:
        raise ValueError("a limit and ids exclude each other")
    if limit is not None and limit < 1:
        raise ValueError("the limit must be positive")
    if limit is not None:
        return examples.orderBy("line_number").limit(limit)
    if ids is None:
        return examples.orderBy("line_number")
    asked = examples.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
    unknown = [r.id for r in asked.join(examples, "id", "left_anti").orderBy("id").collect()]  # of what was asked for
    if unknown:
        raise ValueError(f"unknown question ids: {', '.join(unknown)}")
    return examples.join(F.broadcast(asked), "id", "left_semi").orderBy("line_number")  # what was typed


def completeness(records: DataFrame, layout: str) -> DataFrame:
    """Share of layouts with exactly one record of each task."""
    per = records.groupBy(layout, "task").agg(F.count(F.lit(1)).alias("n")).groupBy(layout).agg(F.count(F.lit(1)).alias("tasks"), F.max("n").alias("most"), F.sum("n").alias("all"))
    whole = (F.col("tasks") == len(TASKS)) & (F.col("most") == 1) & (F.col("all") == len(TASKS))
    return per.agg(F.count(F.lit(1)).alias("layouts"), F.count_if(whole).alias("complete"), F.round(rate(F.count_if(whole), F.count(F.lit(1))), 6).alias("rate"))


def source_deviation(chosen: DataFrame, everything: DataFrame, source: str) -> DataFrame:
    """Share of each source among what was chosen and among all, and the gap; sources of either side count."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
        return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select(source, (F.col("n") / F.col("all")).alias(name))  # one row is broadcast

    both = shares(chosen, "observed").join(shares(everything, "population"), source, "full").fillna(0.0, ["observed", "population"])
    return both.select(source, *(F.round(c, 6).alias(c) for c in ("observed", "population")), F.round(F.abs(F.col("observed") - F.col("population")), 6).alias("gap"))


def gates(metrics: DataFrame) -> DataFrame:
    """Metrics (metric, value) that have a threshold, and whether they reach it; those without are left out."""
    least = metrics.sparkSession.createDataFrame(list(GATES.items()), "metric string, threshold double")
    return metrics.join(F.broadcast(least), "metric").select("metric", F.round("value", 6).alias("value"), "threshold", (F.col("value") >= F.col("threshold")).alias("passed"))


def snapshot(pairs: DataFrame, *more: Column) -> DataFrame:
    """One row for calls that were answered in two ways (columns tool, ours, theirs): how many agree, how the verdicts fall, and ``more`` counts.

    ours and theirs are numbers; verdicts are 1 (true), 0 (false) and null (inconclusive).
    """
    agree = F.col("ours").isNull() & F.col("theirs").isNull() | (F.abs(F.col("ours") - F.col("theirs")) <= 0.001)
    verdict = F.col("tool") == "find_space_with_size"
    return pairs.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.coalesce(agree, F.lit(False))).alias("matches"), F.count_if(verdict & (F.col("ours") == 1)).alias("n_true"),
        F.count_if(verdict & (F.col("ours") == 0)).alias("n_false"), F.count_if(verdict & F.col("ours").isNull()).alias("n_inconclusive"), *more,
    )
