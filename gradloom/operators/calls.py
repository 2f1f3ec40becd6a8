"""Calls of language models: remembered, within a budget, and many rows to a call.

An answer that was given is written to a table by the prompt's hash, task after task, and a prompt is asked only
when the table doesn't hold it. So a job that is run again, or that goes on after it was stopped, asks nothing twice that
was committed. All prompts are asked in one job, each task of which commits its own answers as it ends; a task that is
stopped or that Spark repeats asks its own rows again, which is why tasks are bounded. Prompts that all models fail on are
not remembered.

Budgets are counted before anything is asked: pairs that a model is to judge are ranked within their module, those beyond the budget
are decided as the rule says. Rows that share a call are packed in bounded lists, in order, and the reply is taken
apart by position: too short replies are padded, malformed ones count as none.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradloom.functions.classify import hybrid_same
from gradloom.functions.rewrite import strip
from gradloom.lineage import cut
from gradloom.operators.plugins import Llm, ask, same_verdict, similarity_verdict

ANSWERS = "h string, answer string, model string"
#: A task's file is there for good when the task ends, and not only when all have.
EACH_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
#: From so many tasks on they hold more calls each: starting a task and writing its file takes some 0.15 s of a core.
TASKS = 2000
# How many pairs of a module are judged, how sure a confirmation is to be, what goes into a list and what comes out.
REFINE_BUDGET, SURE, SAMPLE, SAMPLE_CHARS, LIST_ROWS, LIST_CHARS = 100, 80, 5, 200, 12, 350
PAGE_SEPARATOR = "\n\n=== PAGE SEPARATOR ===\n\n"
SEPARATORS, PAGE_HEAD = r"(?i)===\s*PAGE SEPARATOR\s*===", r"(?i)PAGE\s+\d+\s*:\s*"

Chain = list[tuple[str, Llm]]


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """What has been answered so far: a row for each call."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    exists = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(ANSWERS).parquet(folder) if exists else spark.createDataFrame([], ANSWERS)


def ask_once(prompts: DataFrame, key: Sequence[str], prompt: str, chain: Chain, folder: str, at_a_time: int = 2000, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """``key, answer, model`` of every row. ``folder`` holds the answers; equal prompts are one call.

    The tasks that run together hold about ``at_a_time`` calls whose answers aren't committed; where that makes more than ``TASKS``
    tasks, each holds its share of all calls, up to about ``at_a_time``. A null prompt isn't asked and has no answer.
    """
    spark = prompts.sparkSession
    wanted = prompts.select(*key, F.sha2(prompt, 256).alias("h"))
    distinct = prompts.where(F.col(prompt).isNotNull()).select(F.sha2(prompt, 256).alias("h"), F.col(prompt).alias("prompt")).dropDuplicates(["h"])
    missing = cut(distinct.join(answers(spark, folder).select("h"), "h", "left_anti"), "prompts")
    if calls := missing.count():
        cores = spark.sparkContext.defaultParallelism
        each = min(at_a_time, max(1, at_a_time // cores, -(-calls // TASKS)))
        dealt = missing.repartition(max(-(-calls // each), min(calls, cores)), "h")
        ask(dealt, "h", "prompt", chain, tries, wait).where("answer IS NOT NULL").write.options(**EACH_TASK).mode("append").parquet(folder)
    known = answers(spark, folder).dropDuplicates(["h"])
    return wanted.join(known, "h", "left").select(*key, "answer", F.coalesce("model", F.lit("none")).alias("model"))


def within_budget(rows: DataFrame, by: Sequence[str], order: Sequence[str], budget: int, needed: Column) -> DataFrame:
    """``rows`` with ``in_budget``: the first ``budget`` rows of each group by ``order`` of those that are ``needed``."""
    w = Window.partitionBy(*by, "__needed").orderBy(*order)
    ranked = rows.withColumn("__needed", F.coalesce(needed, F.lit(False))).withColumn("in_budget", F.col("__needed") & (F.row_number().over(w) <= budget))
    return ranked.drop("__needed")


def _pair(a: str, b: str, head: str) -> Column:
    return F.concat(F.lit(head + "\nA: "), F.coalesce(F.col(a), F.lit("")), F.lit("\nB: "), F.coalesce(F.col(b), F.lit("")))


def _with_first(members: DataFrame, text: str) -> DataFrame:
    """Each member beside the text of its cluster's first one (``seen`` = 1)."""
    return members.join(members.where("seen = 1").select("cluster", F.col(text).alias("first_text")), "cluster")


SIMILAR_HEAD = "Do these exam questions ask for the same thing? Reply 'Verdict: SIMILAR or DIFFERENT' and 'Confidence: 0 to 100'."
SAME_HEAD = "Are these exam questions the same question? Reply 'Same: YES or NO', 'Confidence: 0 to 100' and 'Reason'."


def refined(members: DataFrame, by: Sequence[str], key: Sequence[str], text: str, score: str, chain: Chain, folder: str, budget: int = REFINE_BUDGET, **options) -> DataFrame:
    """``members`` (cluster, ``seen`` from 1, ``text``, ``score``: the similarity to the first member) with ``stays, in_budget, asked``.

    The first ``budget`` members of a module (``by``), cluster after cluster, are judged: alike from 0.85, different below 0.65, between
    them by a model, and by 0.75 where no model answers. A member that doesn't stay becomes a cluster of its own; those beyond the budget stay.
    """
    rows = cut(within_budget(_with_first(members, text), by, ["cluster", "seen", *key], budget, F.col("seen") > 1), "judged")
    between = F.col("in_budget") & (F.col(score) >= 0.65) & (F.col(score) < 0.85)
    asked = rows.where(between).withColumn("prompt", _pair("first_text", text, SIMILAR_HEAD))
    similar, _ = similarity_verdict(F.col("answer"))
    verdicts = ask_once(asked, ["cluster", *key], "prompt", chain, folder, **options).select("cluster", *key, F.when(F.col("model") != "none", similar).alias("confirmed"), F.lit(True).alias("asked")).dropDuplicates(["cluster", *key])
    judged = rows.join(verdicts, ["cluster", *key], "left")
    stays = F.when(F.col("in_budget"), hybrid_same(F.col(score), F.col("confirmed"))).otherwise(F.lit(True))
    return judged.withColumn("stays", F.coalesce(stays, F.lit(True))).withColumn("asked", F.coalesce("asked", F.lit(False))).drop("first_text", "confirmed")


def confirmed(members: DataFrame, by: Sequence[str], key: Sequence[str], text: str, chain: Chain, folder: str, budget: int | None = None, least: int = SURE, **options) -> DataFrame:
    """``by, cluster, members, asked, confirmed``: whether a model says of each member that it is the same question as the first, sure by
    ``least`` or more. A pair that no model answers, or beyond the module's ``budget``, is taken as the same."""
    rows = within_budget(_with_first(members, text), by, ["cluster", "seen", *key], 2**31 if budget is None else budget, F.col("seen") > 1)
    asked = cut(rows.where("in_budget").withColumn("prompt", _pair("first_text", text, SAME_HEAD)), "confirmed")
    same, sure = same_verdict(F.col("answer"))
    bad = ask_once(asked, ["cluster"], "prompt", chain, folder, **options).groupBy("cluster").agg(F.count(F.lit(1)).alias("asked"), F.bool_or((F.col("model") != "none") & ~(same & (sure >= least))).alias("bad"))
    n = members.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("members"))
    return n.join(bad, "cluster", "left").select(*by, "cluster", "members", F.coalesce("asked", F.lit(0)).alias("asked"), (~F.coalesce("bad", F.lit(False))).alias("confirmed"))


def ask_together(rows: DataFrame, by: Sequence[str], order: Sequence[str], text: str, head: str, accept: Callable[[Column], Column], chain: Chain, folder: str, most_rows: int = LIST_ROWS, most_chars: int = LIST_CHARS, **options) -> DataFrame:
    """``rows`` with ``reply, accepted``: texts of a group go to a model in numbered lists of ``most_rows``, of each at most ``most_chars``
    characters, and a JSON array of strings comes back, one for each in order.

    ``reply`` is the row's own entry, null where the reply is too short, malformed or missing; ``accepted`` is it where
    ``accept`` holds, else the text as it was.
    """
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    dealt = cut(rows.withColumn("__at", at).withColumn("__place", F.to_json(F.struct(*by))).withColumn("__list", F.floor(F.col("__at") / most_rows)).withColumn("__pos", (F.col("__at") % most_rows).cast("int")), "dealt")
    line = F.concat(F.col("__pos") + 1, F.lit(". "), F.substring(strip(F.coalesce(F.col(text), F.lit(""))), 1, most_chars))
    lists = dealt.groupBy("__place", "__list").agg(F.array_sort(F.collect_list(F.struct("__pos", line.alias("line")))).alias("ls"))  # most_rows at most
    prompts = lists.select("__place", "__list", F.concat(F.lit(head + "\n"), F.array_join(F.transform("ls", lambda s: s["line"]), "\n"), F.lit("\n\nReturn only a JSON array of strings, one for each line, in the same order.")).alias("prompt"))
    replies = ask_once(prompts, ["__place", "__list"], "prompt", chain, folder, **options)
    entries = F.from_json(F.regexp_extract("answer", r"(?s)\[.*\]", 0), "array<string>")
    each = dealt.join(replies.select("__place", "__list", entries.alias("__entries")), ["__place", "__list"], "left").withColumn("reply", strip(F.get("__entries", F.col("__pos"))))
    good = F.coalesce(accept(F.col("reply")), F.lit(False))
    return each.withColumn("accepted", F.when(good, F.col("reply")).otherwise(F.col(text))).drop("__at", "__place", "__list", "__pos", "__entries")


def topic_labels(topics: DataFrame, by: Sequence[str], order: Sequence[str], name: str, chain: Chain, folder: str, **options) -> DataFrame:
    """``topics`` with ``label``: a short name by a model where that has more than 2 and less than 80 characters, else the name itself."""
    found = ask_together(topics, by, order, name, "Give each of these exam topics a precise academic label of 3 to 6 words.", lambda r: (F.length(r) > 2) & (F.length(r) < 80), chain, folder, most_rows=50, most_chars=500, **options)
    return found.withColumnRenamed("accepted", "label").drop("reply")


def cleaned_questions(questions: DataFrame, by: Sequence[str], order: Sequence[str], text: str, chain: Chain, folder: str, **options) -> DataFrame:
    """``questions`` with ``cleaned``: the text that a model repaired, where it has ten characters or more; null where not."""
    found = ask_together(questions, by, order, text, "Repair these recognised exam questions: misread words, stray marks and ends that were cut off; null for what is none.", lambda r: F.length(r) >= 10, chain, folder, **options)
    return found.withColumn("cleaned", F.when(F.length("reply") >= 10, F.col("reply"))).drop("reply", "accepted")


def cluster_labels(members: DataFrame, cluster: str, order: Sequence[str], text: str, fallback: Column, chain: Chain, folder: str, **options) -> DataFrame:
    """``cluster, label``: a model names the topic of a cluster's first five questions, of each 200 characters; ``fallback`` where none answers."""
    first = members.withColumn("__r", F.row_number().over(Window.partitionBy(cluster).orderBy(*order))).where(F.col("__r") <= SAMPLE)
    line = F.concat(F.lit("- "), F.substring(F.coalesce(F.col(text), F.lit("")), 1, SAMPLE_CHARS))
    samples = first.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("__r", line.alias("line")))).alias("ls"))  # five at most
    prompts = samples.select(cluster, F.concat(F.lit("Name the main topic of these exam questions in 2 to 5 words.\n"), F.array_join(F.transform("ls", lambda s: s["line"]), "\n")).alias("prompt"))
    return ask_once(prompts, [cluster], "prompt", chain, folder, **options).select(cluster, F.coalesce(F.nullif(strip(F.col("answer")), F.lit("")), fallback).alias("label"))


def cleaned_pages(pages: DataFrame, paper: str, page: str, text: str, chain: Chain, folder: str, most_chars: int = 40_000, **options) -> DataFrame:
    """``paper, page, text, cleaned, model``: a paper's pages go to a model together, with separators, and come back by position.

    Pages of a paper that are longer together than ``most_chars`` take several calls. A reply with too few pages leaves the last ones
    empty, one with too many is cut; where no model answers the pages stay as they are.
    """
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    before = F.sum(size).over(Window.partitionBy(paper).orderBy(page).rowsBetween(Window.unboundedPreceding, -1))
    batched = pages.select(paper, page, F.coalesce(F.col(text), F.lit("")).alias("text"), F.floor(F.coalesce(before, F.lit(0)) / most_chars).alias("__call"))
    calls = batched.groupBy(paper, "__call").agg(F.array_sort(F.collect_list(F.struct(page, "text"))).alias("ps"))
    calls = cut(calls.withColumn("prompt", F.concat(F.lit("Clean the recognition errors of this exam paper and keep its page separators.\n\n"), F.array_join(F.transform("ps", lambda p, i: F.concat(F.lit("PAGE "), i + 1, F.lit(":\n"), p["text"])), PAGE_SEPARATOR))), "calls")
    replies = ask_once(calls, [paper, "__call"], "prompt", chain, folder, **options)
    parts = F.filter(F.transform(F.split("answer", SEPARATORS, -1), lambda p: strip(F.regexp_replace(p, PAGE_HEAD, ""))), lambda p: p != "")
    both = calls.drop("prompt").join(replies, [paper, "__call"]).select(paper, "model", F.col("ps"), F.when(F.col("model") != "none", parts).alias("parts"))
    each = both.select(paper, "model", "parts", F.posexplode("ps").alias("i", "p"))
    return each.select(paper, f"p.{page}", "p.text", F.when(F.col("parts").isNull(), F.col("p.text")).otherwise(F.coalesce(F.get("parts", F.col("i")), F.lit(""))).alias("cleaned"), "model")
