"""Queries over answers, messages, results and seeded choices on the driver tables, with their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, seeded, text
from ..operators import relations, results
from ..sources.driver_tables import LAYOUT_SQL, entities, rooms

SEED, SAMPLE = 7, 100
SCORED = ("pair_distance", "view_angle", "repositioning", "max_box", "free_space", "count")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, task, expected and response: an answer per order, as a model might write it, right or a few percent off."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    milli = (F.col("o_custkey") % 900 + 100) * 1000 + k % 1000
    given = milli + F.floor(milli * (k % 13 - 6) / 200.0)
    as_text = lambda n: F.concat(F.floor(n / 1000.0).cast("long").cast("string"), F.lit("."), F.lpad((n.cast("long") % 1000).cast("string"), 3, "0"))
    value = as_text(given)
    forms = [
        F.lit("I could not work it out."), F.concat(F.lit("**Final answer**: "), value, F.lit(" m")), F.concat(F.lit("so\nfinal answer : "), value, F.lit("**")),
        F.concat(F.lit("*Final answer*: 1\nno, *Final answer*: "), value, F.lit(" square meters")), F.concat(F.lit("Final Answer: about "), value),
    ]
    return o.select(
        k.alias("id"), F.element_at(F.array(*map(F.lit, SCORED)), (k % len(SCORED) + 1).cast("int")).alias("task"), as_text(milli).alias("expected"),
        F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int")).alias("response"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir).withColumn("parsed", text.final_answer(F.col("response")))
    return a.select("id", "task", "expected", "parsed", text.scalar_correct(F.col("task"), F.col("parsed"), F.col("expected")).alias("correct"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored answers with an error text for some, tokens and a duration."""
    s = scored(spark, sf_dir)
    error = F.when(F.col("id") % 97 == 0, F.lit("timeout"))
    return s.select("id", "task", "parsed", (F.col("correct") & error.isNull()).alias("correct"), error.alias("error"), (F.col("id") % 500).alias("tokens"), ((F.col("id") % 40) / F.lit(8.0)).alias("duration"))


def _visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per room: the set of types expected, one given in another order and case, and whether it is the same set."""
    e = entities(spark, sf_dir).groupBy("room_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "type"))), lambda s: s["type"]).alias("expected"))
    given = F.transform(F.reverse("expected"), F.upper)
    given = F.when(F.col("room_id") % 3 == 0, F.slice(given, 2, 100)).otherwise(given)
    return e.select("room_id", text.same_set(F.col("expected"), given).alias("correct"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input messages of conversations: system and user turns in order, of those with a user turn."""
    c = _table(spark, sf_dir, "conversations").where("role in ('system', 'user') and text is not null")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_user"), F.count(F.lit(1)).alias("n_messages"), F.sha2(F.array_join(F.transform(turns, lambda t: F.concat_ws(":", t["role"], t["text"])), "\n"), 256).alias("sha")).where("n_user > 0")


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = relations.inspect_room(rooms(spark, sf_dir), entities(spark, sf_dir))
    return g.select("room_id", "kind", "type", text.group_line(F.col("type"), F.col("ids"), F.col("n")).alias("line"))


def _calculator(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem")
    operator = F.element_at(F.array(*map(F.lit, ("add", "sub", "mul", "div", "pow"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    x, y = F.col("l_quantity"), F.col("l_discount") + 0.0
    value = text.calculate(x, y, operator)
    status = F.when(operator == "pow", "unknown operator").when((operator == "div") & (y == 0), "Error").otherwise("ok")
    return line.select(operator.alias("operator"), status.alias("status"), value.alias("value")).groupBy("operator", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    x, y = geometry.ring_centroid(F.col("embedding"))
    return e.select("vec_id", F.round(geometry.ring_area(F.col("embedding")), 6).alias("area"), F.round(x, 3).alias("cx"), F.round(y, 3).alias("cy"))


def _valid_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.validation(rooms(spark, sf_dir), entities(spark, sf_dir)).where("valid").select("room_id")


def _deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rooms(spark, sf_dir)
    return results.source_deviation(r.join(_valid_rooms(spark, sf_dir), "room_id", "left_semi"), r, "source_group")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run with tools per user: their events in order are the calls."""
    e = _table(spark, sf_dir, "events").select("user_id", F.struct("event_id", F.col("event_type").alias("tool"), "value").alias("c"))
    runs = e.groupBy("user_id").agg(F.array_sort(F.collect_list("c")).alias("tool_trace"))
    u = F.col("user_id")
    return runs.select("user_id", "tool_trace", (u % 3 == 0).alias("correct"), F.when(u % 11 == 0, "timeout").alias("error"), (u % 700).alias("generated_tokens"), (u % 8 + 1).alias("model_calls"))


def _picked(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    a = answers(spark, sf_dir).select(F.concat(F.lit("q-"), F.col("id").cast("string")).alias("id"), F.col("id").alias("line_number"), "task")
    return results.selected(a, **how)


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rooms(spark, sf_dir).join(entities(spark, sf_dir).select("room_id").distinct(), "room_id", "left_semi")
    v = relations.validation(r, entities(spark, sf_dir))
    run = scored(spark, sf_dir)
    metrics = v.agg(results.rate(F.count_if("valid"), F.count(F.lit(1))).alias("value")).select(F.lit("complete_layout_yield").alias("metric"), "value")
    metrics = metrics.unionByName(run.agg(results.rate(F.count("parsed"), F.count(F.lit(1))).alias("value")).select(F.lit("prompt_validity_rate").alias("metric"), "value"))
    metrics = metrics.unionByName(run.agg(results.rate(F.count("id"), F.count(F.lit(1))).alias("value")).select(F.lit("schema_validity_rate").alias("metric"), "value"))
    return results.gates(metrics)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "final_answer": lambda s, d: answers(s, d).select("id", text.final_answer(F.col("response")).alias("parsed")),
    "numeric_answer": lambda s, d: answers(s, d).select("id", text.number(text.final_answer(F.col("response"))).cast("double").alias("number")),
    "score_scalar": scored,
    "score_set": _visibility,
    "input_messages": _messages,
    "inventory_lines": _inventory,
    "calculator": _calculator,
    "polygon_area_centroid": _rings,
    "layout_sample": lambda s, d: seeded.layout_sample(rooms(s, d).select("room_id", "source_group"), "room_id", SAMPLE, SEED),
    "boolean_schedule": lambda s, d: seeded.boolean_schedule(seeded.layout_sample(rooms(s, d).select("room_id"), "room_id", SAMPLE, SEED), "room_id", "placement", SEED),
    "seeded_pair": lambda s, d: seeded.pair_choice(entities(s, d).select("room_id", "label"), "room_id", "label", "pair_distance", SEED),
    "task_counts": lambda s, d: results.task_counts(answers(s, d)),
    "boolean_counts": lambda s, d: results.boolean_counts(relations.placement_axis_aligned(rooms(s, d), entities(s, d)), "item", F.col("fits")),
    "run_summary": lambda s, d: results.run_summary(_results(s, d)),
    "by_task": lambda s, d: results.by_task(_results(s, d)),
    "failed_ids": lambda s, d: _results(s, d).where("not correct").select("id", "task"),
    "tool_usage": lambda s, d: results.usage(_runs(s, d)),
    "agent_summary": lambda s, d: results.agent_summary(_runs(s, d)),
    "selected_distributions": lambda s, d: results.distributions(answers(s, d).withColumn("source", F.col("id") % 4), "task", "source"),
    "source_counts": lambda s, d: results.source_counts(entities(s, d).join(rooms(s, d), "room_id"), "source_group", "room_id"),
    "first_questions": lambda s, d: _picked(s, d, limit=50),
    "completeness": lambda s, d: results.completeness(answers(s, d).withColumn("layout", F.floor(F.col("id") / 8.0)), "layout"),
    "source_deviation": _deviation,
    "gates": _gates,
}


def _pick(values, n: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({n}) % {len(values)} + 1]"


_ANSWERS = f"""o AS (SELECT o_orderkey AS id, (o_custkey % 900 + 100) * 1000 + o_orderkey % 1000 AS milli FROM orders),
g AS (SELECT *, (milli + floor(milli * (id % 13 - 6) / 200.0::double))::bigint AS given FROM o),
t AS (SELECT id, {_pick(SCORED, "id")} AS task, (milli // 1000) || '.' || lpad((milli % 1000)::varchar, 3, '0') AS expected, (given // 1000) || '.' || lpad((given % 1000)::varchar, 3, '0') AS value FROM g),
answers AS (SELECT id, task, expected, ['I could not work it out.', '**Final answer**: ' || value || ' m', 'so' || chr(10) || 'final answer : ' || value || '**',
   '*Final answer*: 1' || chr(10) || 'no, *Final answer*: ' || value || ' square meters', 'Final Answer: about ' || value][id % 5 + 1] AS response FROM t),
parsed AS (SELECT *, trim(regexp_replace(trim(regexp_extract_all(response, '(?i)\\*{{0,2}}final\\s+answer\\*{{0,2}}\\s*:\\s*([^\\n]+)', 1)[-1]), '[*_`]+$', '')) AS parsed FROM answers),
num AS (SELECT *, try_cast(nullif(regexp_extract(parsed, '(?i)^\\s*([-+]?(?:\\d+(?:\\.\\d*)?|\\.\\d+)(?:e[-+]?\\d+)?)(?:\\s*(?:m|meters?|m²|square\\s+meters?))?\\s*$', 1), '') AS decimal(18, 6)) AS a, expected::decimal(18, 6) AS e FROM parsed),
scored AS (SELECT id, task, expected, parsed, coalesce(CASE WHEN parsed IS NULL THEN false
    WHEN a IS NOT NULL THEN CASE WHEN task = 'count' THEN a = e ELSE abs(a - e) <= abs(e) * CASE task WHEN 'free_space' THEN 0.05 ELSE 0.02 END END
    ELSE lower(parsed) = lower(expected) END, false) AS correct FROM num),
results AS (SELECT id, task, parsed, correct AND id % 97 <> 0 AS correct, CASE WHEN id % 97 = 0 THEN 'timeout' END AS error, id % 500 AS tokens, (id % 40) / 8.0::double AS duration FROM scored)"""


def _on_answers(query: str) -> str:
    return f"WITH {_ANSWERS}\n{query}"


def _on_layouts(*parts: str) -> str:
    return "WITH " + ",\n".join([LAYOUT_SQL.strip(), *parts[:-1]]) + "\n" + parts[-1]


def _oracles() -> dict[str, str]:
    from .layout_queries import ORACLES as layouts

    valid = layouts["validation"]
    gates = ", ".join(f"('{k}', {v}::double)" for k, v in results.GATES.items())
    tasks = ", ".join(f"('{t}')" for t in results.TASKS)
    ring = "SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e, len(embedding) AS n FROM embeddings"
    step = "list_transform(range(1, n, 2), lambda i: {})"
    x, y, u, v = "e[i]", "e[i + 1]", "e[(i + 1) % n + 1]", "e[(i + 2) % n + 1]"
    cross = f"({x} * {v} - {u} * {y})"
    fold = lambda value: f"list_sum({step.format(value)})"
    plural = r"CASE WHEN n = 1 THEN name WHEN regexp_matches(name, '[^aeiou ]y$') THEN regexp_replace(name, 'y$', 'ies') WHEN regexp_matches(name, '(s|x|z|ch|sh)$') THEN name || 'es' ELSE name || 's' END"
    return {
        "final_answer": _on_answers("SELECT id, parsed FROM parsed"),
        "numeric_answer": _on_answers("SELECT id, a::double AS number FROM num"),
        "score_scalar": _on_answers("SELECT * FROM scored"),
        "score_set": _on_layouts(
            "s AS (SELECT room_id, list(type ORDER BY seq) AS expected FROM entities GROUP BY room_id)",
            "g AS (SELECT room_id, expected, CASE WHEN room_id % 3 = 0 THEN list_reverse(expected)[2:] ELSE list_reverse(expected) END AS given FROM s)",
            "SELECT room_id, list_sort(list_distinct(expected)) = list_sort(list_distinct(given)) AS correct FROM g",
        ),
        "input_messages": "SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) AS n_messages, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn, role, text)) AS sha FROM conversations WHERE role IN ('system', 'user') AND text IS NOT NULL GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0",
        "inventory_lines": _on_layouts(
            "g AS (SELECT room_id, kind, type, replace(type, '_', ' ') AS name, count(*) AS n, string_agg(label, ', ' ORDER BY seq) AS ids FROM entities GROUP BY ALL)",
            f"SELECT room_id, kind, type, '- ' || n || ' ' || ({plural}) || ' with ' || CASE WHEN n = 1 THEN 'ID' ELSE 'IDs' END || ' [' || ids || '].' AS line FROM g",
        ),
        "calculator": f"""WITH c AS (SELECT {_pick(("add", "sub", "mul", "div", "pow"), "l_partkey")} AS operator, l_quantity AS x, l_discount + 0.0 AS y FROM lineitem)
SELECT operator, CASE WHEN operator = 'pow' THEN 'unknown operator' WHEN operator = 'div' AND y = 0 THEN 'Error' ELSE 'ok' END AS status, count(*) AS n,
       round(sum(CASE operator WHEN 'add' THEN x + y WHEN 'sub' THEN x - y WHEN 'mul' THEN x * y WHEN 'div' THEN CASE WHEN y <> 0 THEN x / y END END), 4) AS total FROM c GROUP BY ALL""",
        "polygon_area_centroid": f"WITH r AS ({ring}) SELECT vec_id, round(abs({fold(cross)}) / 2, 6) AS area, round({fold(f'({x} + {u}) * {cross}')} / (3 * {fold(cross)}), 3) AS cx, round({fold(f'({y} + {v}) * {cross}')} / (3 * {fold(cross)}), 3) AS cy FROM r",
        "layout_sample": _on_layouts(f"k AS (SELECT room_id, source_group, sha256('{SEED}:layout-order:' || room_id) AS k FROM rooms)", f"SELECT room_id, source_group, row_number() OVER (ORDER BY k)::int AS rank FROM k ORDER BY k LIMIT {SAMPLE}"),
        "boolean_schedule": _on_layouts(
            f"k AS (SELECT room_id, row_number() OVER (ORDER BY sha256('{SEED}:layout-order:' || room_id))::int AS rank FROM rooms)",
            f"SELECT room_id, rank, row_number() OVER (ORDER BY sha256('{SEED}:boolean-answers:placement:' || room_id)) > {SAMPLE // 2} AS target FROM k WHERE rank <= {SAMPLE}",
        ),
        "seeded_pair": _on_layouts(
            f"k AS (SELECT room_id, label, row_number() OVER (PARTITION BY room_id ORDER BY sha256('{SEED}:' || room_id || ':pair_distance:' || label), label) AS k FROM entities)",
            "SELECT a.room_id, a.label AS object_1, b.label AS object_2 FROM k a JOIN k b ON a.room_id = b.room_id AND a.k = 1 AND b.k = 2",
        ),
        "task_counts": _on_answers(f"SELECT n.task, count(answers.id) AS n FROM (VALUES {tasks}) n(task) LEFT JOIN answers ON answers.task = n.task GROUP BY n.task"),
        "boolean_counts": f"SELECT item, count(*) FILTER (fits) AS n_true, count(*) FILTER (NOT fits) AS n_false FROM ({layouts['placement_axis_aligned']}) GROUP BY item",
        "run_summary": _on_answers("SELECT count(*) AS completed, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) / count(*)::double, 6) AS score, count(*) FILTER (parsed IS NULL AND error IS NULL) AS formatting_failures, count(error) AS errors, sum(tokens)::bigint AS tokens, round(sum(duration), 4) AS duration FROM results"),
        "by_task": _on_answers("SELECT task, count(*) FILTER (correct) AS correct, count(*) AS total, count(*) FILTER (parsed IS NULL AND error IS NULL) AS formatting_failures, count(error) AS errors FROM results GROUP BY task"),
        "failed_ids": _on_answers("SELECT id, task FROM results WHERE NOT correct"),
        "tool_usage": "WITH runs AS (SELECT user_id, list(event_type) AS trace FROM events GROUP BY user_id) SELECT tool, count(*) AS n FROM (SELECT unnest(trace) AS tool FROM runs) GROUP BY tool",
        "agent_summary": "WITH runs AS (SELECT user_id AS u, count(*) AS calls FROM events GROUP BY user_id) SELECT count(*) AS completed, count(*) FILTER (u % 3 = 0) AS correct, round(count(*) FILTER (u % 3 = 0) / count(*)::double, 6) AS score, count(*) FILTER (u % 11 = 0) AS errors, sum(u % 700)::bigint AS generated_tokens, sum(u % 8 + 1)::bigint AS model_calls, sum(calls)::bigint AS tool_calls FROM runs",
        "selected_distributions": _on_answers("SELECT what, value, count(*) AS n FROM (SELECT 'task' AS what, task AS value FROM answers UNION ALL SELECT 'source', (id % 4)::varchar FROM answers) GROUP BY ALL"),
        "source_counts": _on_layouts("SELECT source_group, count(DISTINCT r.room_id) AS layouts FROM rooms r JOIN entities e ON e.room_id = r.room_id GROUP BY ALL"),
        "first_questions": _on_answers("SELECT 'q-' || id AS id, id AS line_number, task FROM answers ORDER BY line_number LIMIT 50"),
        "completeness": _on_answers(f"""SELECT count(*) AS layouts, count(*) FILTER (ok) AS complete, round(count(*) FILTER (ok) / count(*)::double, 6) AS rate
FROM (SELECT layout, count(*) = {len(results.TASKS)} AND max(n) = 1 AND sum(n) = {len(results.TASKS)} AS ok FROM (SELECT id // 8 AS layout, task, count(*) AS n FROM answers GROUP BY ALL) GROUP BY layout)"""),
        "source_deviation": f"""WITH v AS (SELECT room_id FROM ({valid}) WHERE valid), r AS (SELECT room_id, source_group FROM (WITH {LAYOUT_SQL} SELECT * FROM rooms)),
a AS (SELECT source_group, count(*) / (SELECT count(*) FROM v)::double AS observed FROM r WHERE room_id IN (SELECT room_id FROM v) GROUP BY ALL), b AS (SELECT source_group, count(*) / (SELECT count(*) FROM r)::double AS population FROM r GROUP BY ALL)
SELECT source_group, round(coalesce(observed, 0), 6) AS observed, round(coalesce(population, 0), 6) AS population, round(abs(coalesce(observed, 0) - coalesce(population, 0)), 6) AS gap FROM a FULL JOIN b USING (source_group)""",
        "gates": f"""WITH least(metric, threshold) AS (VALUES {gates}), v AS ({valid}), {_ANSWERS},
m AS (SELECT 'complete_layout_yield' AS metric, count(*) FILTER (valid) / count(*)::double AS value FROM v UNION ALL SELECT 'prompt_validity_rate', count(parsed) / count(*)::double FROM scored UNION ALL SELECT 'schema_validity_rate', count(id) / count(*)::double FROM scored)
SELECT metric, round(value, 6) AS value, threshold, value >= threshold AS passed FROM m JOIN least USING (metric)""",
    }


ORACLES: dict[str, str] = _oracles()
