"""Column expressions over labels, answers and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tasks whose numbers may be off by a share, and the share.
RELATIVE = {"pair_distance": "0.02", "view_angle": "0.02", "repositioning": "0.02", "max_box": "0.02", "free_space": "0.05"}
#: The marker of a final answer (for Spark and for Python), and a number with its unit.
FINAL = r"(?i)\*{0,2}final\s+answer\*{0,2}\s*:\s*([^\n]+)"
NUMBER = r"(?i)^\s*([-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:e[-+]?\d+)?)(?:\s*(?:m|meters?|m²|square\s+meters?))?\s*$"


def entity_type(label: Column) -> Column:
    """The label without one trailing number."""
    return F.regexp_replace(label, r"_\d+$", "")


def plural(noun: Column, n: Column) -> Column:
    """Of a noun phrase: the last word inflects."""
    many = (
        F.when(noun.rlike(r"[^aeiou ]y$"), F.regexp_replace(noun, "y$", "ies"))
        .when(noun.rlike(r"(s|x|z|ch|sh)$"), F.concat(noun, F.lit("es")))
        .otherwise(F.concat(noun, F.lit("s")))
    )
    return F.when(n == 1, noun).otherwise(many)


def group_line(kind: Column, ids: Column, n: Column) -> Column:
    """One line of a room's inventory; ``ids``: joined by ", "."""
    name = plural(F.regexp_replace(kind, "_", " "), n)
    return F.concat(F.lit("- "), n.cast("string"), F.lit(" "), name, F.lit(" with "), F.when(n == 1, "ID").otherwise("IDs"), F.lit(" ["), ids, F.lit("]."))


def final_answer(response: Column) -> Column:
    """What follows the last marker, without closing emphasis; null without one."""
    last = F.try_element_at(F.regexp_extract_all(response, F.lit(FINAL), F.lit(1)), F.lit(-1))
    return F.trim(F.regexp_replace(F.trim(last), r"[*_`]+$", ""))


def number(answer: Column) -> Column:
    """A whole answer that is a number with at most a length or area unit, as an exact decimal; else null."""
    return F.nullif(F.regexp_extract(answer, NUMBER, 1), F.lit("")).try_cast("decimal(38,18)")


def normal(answer: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(answer), r"\s+", " "))


def scalar_correct(task: Column, actual: Column, expected: Column) -> Column:
    """Whether an answer text is right for an expected text: numbers by the task's tolerance or to the expected number of decimals, else equal texts."""
    given = F.struct(number(actual).alias("a"), number(expected).alias("e"))
    share = F.lit(None).cast("decimal(4,2)")
    for name, value in RELATIVE.items():
        share = F.when(task == name, F.lit(value).cast("decimal(4,2)")).otherwise(share)
    # half a unit of the expected last place; an exact half goes to the even digit
    halves = F.array(*(F.lit("0." + "0" * k + "5").cast("decimal(16,15)") for k in range(13)))
    half = F.element_at(halves, F.least(F.length(F.regexp_extract(expected, r"\.(\d*)", 1)), F.lit(12)) + 1)
    even = F.regexp_extract(expected, r"(\d)\D*$", 1).isin("0", "2", "4", "6", "8")

    def judged(g: Column) -> Column:
        a, e = g["a"], g["e"]
        off = F.abs(a - e)
        small = F.lit("0.001").cast("decimal(4,3)")
        # exact decimals: comparing off <= share * |e| needs no division
        near = F.when(F.abs(e) <= small, off <= small).otherwise(off <= F.abs(e) * share)
        numeric = F.when(share.isNotNull(), near).otherwise((off < half) | ((off == half) & even))
        return F.when(a.isNotNull() & e.isNotNull(), numeric).otherwise(normal(actual) == normal(expected))

    return F.coalesce(actual.isNotNull() & F.transform(F.array(given), judged)[0], F.lit(False))


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays of labels hold the same, case and order apart."""
    clean = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: F.lower(F.upper(x)))))
    return F.coalesce(clean(a) == clean(b), F.lit(False))


def calculate(x: Column, y: Column, operator: Column) -> Column:
    """Null for a division by zero and for an unknown operator."""
    return F.when(operator == "add", x + y).when(operator == "sub", x - y).when(operator == "mul", x * y).when(operator == "div", F.try_divide(x, y))


def tool_status(output: Column) -> Column:
    """What a placement sentence says: true, false, or null where it is inconclusive."""
    return F.when(output.endswith("The answer is True."), F.lit(True)).when(output.endswith("The answer is False."), F.lit(False))


def tool_distance(output: Column) -> Column:
    """The first length in meters that a sentence names."""
    return F.nullif(F.regexp_extract(output, r"([0-9]+\.[0-9]+) meters", 1), F.lit("")).try_cast("double")
