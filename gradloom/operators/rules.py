"""Classification rules as SQL expressions over ``question_text``, ``keywords`` and ``marks``.

Rules are data that users write. They are never executed as code: a rule is parsed and
analysed by the engine against the question's columns, must be boolean, and may call only
functions of an allowed list.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradloom.functions.rewrite import strip
from gradloom.operators.calls import ask_once
from gradloom.operators.plugins import Llm

SCHEMA = "question_text string, keywords array<string>, marks int"
ALLOWED = frozenset("lower upper length contains startswith endswith like ilike rlike regexp_like array_contains size coalesce nullif abs least greatest trim substring exists any some in between is and or not case when then else end if cast as int string".split())


@dataclass(frozen=True)
class Rule:
    rule_id: str
    expression: str
    priority: int = 0
    is_active: bool = True
    is_validated: bool = False


def validate(spark: SparkSession, expression: str) -> str | None:
    """Why a rule can't be used, null if it can."""
    if re.search(r";|--|/\*|\bselect\b", expression, re.I):
        return "only a single expression is allowed"
    bare = re.sub(r"'(?:[^'\\]|\\.)*'", "''", expression)
    for name in re.findall(r"([A-Za-z_]\w*)\s*\(", bare):
        if name.lower() not in ALLOWED:
            return f"function {name} is not allowed"
    try:
        kind = spark.createDataFrame([], SCHEMA).select(F.expr(expression).alias("v")).dtypes[0][1]
    except Exception as e:
        return f"it can't be read: {str(e).splitlines()[0][:120]}"
    return None if kind == "boolean" else f"it is {kind}, not boolean"


MOST_RULES = 10_000  # written by people; each is analysed by itself
ASK = """Write this {kind} rule for exam questions as one Spark SQL expression that is true or false.
Columns: question_text string, keywords array<string>, marks int (null if unknown). Functions: {allowed}.
Return only the expression.
Rule: """
REPAIR = "\nYour last reply can't be used: "


def expression_of(reply: Column) -> Column:
    """The expression of a model's reply, without the fences and the words of code blocks."""
    return F.nullif(strip(F.regexp_replace(strip(reply), r"(?s)\A```[a-z]*\s*|\s*```\z", "")), F.lit(""))


def compile_rules(wanted: DataFrame, chain: list[tuple[str, Llm]], folder: str, **options) -> DataFrame:
    """``rule_id, expression, error, tries`` of rules in plain words (rule_id, kind, words).

    A model writes each as an expression, which is checked like one that a user writes: one expression, allowed functions, boolean, readable. One that
    isn't goes back once with what is wrong. ``expression`` is null where the second reply can't be used either, or none came;
    what was refused is nowhere kept as a rule.
    """
    spark = wanted.sparkSession
    head = F.concat(F.lit(ASK.split("{kind}")[0]), F.coalesce("kind", F.lit("classification")), F.lit(ASK.split("{kind}")[1].format(allowed=", ".join(sorted(ALLOWED)))), F.coalesce("words", F.lit("")))
    asked = wanted.select("rule_id", head.alias("prompt"))
    done: list[tuple[str, str | None, str | None, int]] = []
    for tries in (1, 2):
        replies = ask_once(asked, ["rule_id", "prompt"], "prompt", chain, folder, **options).select("rule_id", "prompt", expression_of(F.col("answer")).alias("expression")).limit(MOST_RULES + 1).collect()
        if len(replies) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules at once")
        again = []
        for r in replies:
            error = "no reply" if r["expression"] is None else validate(spark, r["expression"])
            if error is None:
                done.append((r["rule_id"], r["expression"], None, tries))
            elif tries == 2:
                done.append((r["rule_id"], None, error, tries))
            else:
                again.append((r["rule_id"], f"{r['prompt']}{REPAIR}{error}"))
        if not again:
            break
        asked = spark.createDataFrame(again, "rule_id string, prompt string")
    return spark.createDataFrame(done, "rule_id string, expression string, error string, tries int")


def compiled(rules: DataFrame) -> list[Rule]:
    """The rules of :func:`compile_rules` that can be used."""
    return [Rule(r["rule_id"], r["expression"], is_validated=True) for r in rules.where("expression IS NOT NULL").orderBy("rule_id").limit(MOST_RULES).collect()]


def execute_all(questions: DataFrame, rules: list[Rule]) -> DataFrame:
    """Active, validated rules over all questions in one pass: key columns plus ``results``, a map
    of rule to outcome without the rules whose outcome is null."""
    live = sorted((r for r in rules if r.is_active and r.is_validated), key=lambda r: (-r.priority, r.rule_id))
    entries = [F.struct(F.lit(r.rule_id).alias("key"), F.expr(r.expression).alias("value")) for r in live]
    listed = F.filter(F.array(*entries), lambda e: e["value"].isNotNull()) if entries else F.array().cast("array<struct<key:string,value:boolean>>")
    return questions.withColumn("results", F.map_from_entries(listed))
