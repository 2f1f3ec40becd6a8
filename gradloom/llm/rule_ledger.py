"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once for each document. The ledger keeps the measurements the
rules look at and one long, ``failed``, in which bit *i* says that rule *i* failed.
Policies (versioned sets of rules) and ablations ("what would dropping rule X let
through?") then are bitwise work on that long and never read the text again.

Defined results: a null or empty text has no words and so fails ``few_words``; repeated
rows and ties are judged row by row; an empty table gives an empty ledger; columns of the
input besides the text are carried along, also where their names clash with the ledger's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradloom.llm.common import fresh, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measures that is true where a document fails."""

    name: str
    fails: str


#: The order gives the bits: append new rules, never reorder.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 6 * n_lines"),
    Rule("shouting", "n_letters >= 50 AND 10 * n_upper > 5 * n_letters"),
    Rule("few_letters", "2 * n_letters < word_chars"),
)

#: Versioned policies: the rules a version applies. A document is kept if none of them failed.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": ("few_words", "repeated_windows", "short_words", "long_words", "symbols", "few_letters"),
    "web-2": tuple(r.name for r in RULES),
}


def policy_mask(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    at = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << at[n] for n in set(names))


def _repeated_windows(df: DataFrame, w: str, out: str, window_hash=F.xxhash64) -> DataFrame:
    """Adds ``out``: how many words of the array ``w`` lie in 3-word windows that occur twice or more.

    A window becomes one long: a hash in the high bits, its position in as many low bits
    as this text needs (at least 40 bits of hash remain up to 16 million words). Sorting
    the longs brings equal windows together; neighbours with equal hashes are compared
    word by word, so a collision cannot count. Where different windows do share a hash, and so may
    part equal ones, the windows of that text are sorted as strings. n log n time, no shuffle.
    """
    n = F.size(w)
    bits, packed, hits, spots = f"{out}__bits", f"{out}__packed", f"{out}__hits", f"{out}__spots"
    word = lambda i: F.get(F.col(w), i)
    df = df.withColumn(bits, F.length(F.bin(n)))
    low = F.expr(f"(1L << {bits}) - 1")
    df = df.withColumn(
        packed,
        F.when(
            n >= 4,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), n - 3),
                    lambda i: window_hash(word(i), word(i + 1), word(i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")),
                )
            ),
        ),
    )

    def equal_to(x: Column, j: Column, want: bool = True) -> Column:
        y = F.get(F.col(packed), j)
        p, q = x.bitwiseAND(low).cast("int"), y.bitwiseAND(low).cast("int")
        same = (word(p) == word(q)) & (word(p + 1) == word(q + 1)) & (word(p + 2) == word(q + 2))
        return F.coalesce((x.bitwiseXOR(y).bitwiseAND(F.bitwise_not(low)) == 0) & (same == want), F.lit(False))

    clash, wins, twice = f"{out}__clash", f"{out}__wins", f"{out}__twice"
    df = df.withColumn(clash, F.exists(F.transform(packed, lambda x, j: equal_to(x, j - 1, False)), lambda c: c))
    df = df.withColumn(wins, F.when(F.col(clash), F.transform(packed, lambda x: F.concat_ws(" ", *[word(x.bitwiseAND(low).cast("int") + i) for i in range(3)]))))
    df = df.withColumn(twice, F.sort_array(wins))
    df = df.withColumn(twice, F.array_distinct(F.filter(twice, lambda x, j: x == F.get(F.col(twice), j - 1))))
    exact = F.filter(packed, lambda x, j: F.array_contains(F.col(twice), F.get(F.col(wins), j)))
    df = df.withColumn(hits, F.when(F.col(clash), exact).otherwise(F.filter(packed, lambda x, j: equal_to(x, j - 1) | equal_to(x, j + 1))))
    df = df.withColumn(spots, F.sort_array(F.transform(hits, lambda x: x.bitwiseAND(low))))
    # each window adds the words that the one before it has not covered
    total = F.size(spots) * 3 - F.aggregate(
        F.transform(spots, lambda x, j: F.when(j > 0, F.greatest(F.lit(0).cast("long"), 3 - x + F.get(F.col(spots), j - 1))).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return df.withColumn(out, F.when(F.size(spots) > 0, total).otherwise(0).cast("long")).drop(bits, packed, hits, spots, clash, wins, twice)


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the columns of ``MEASURES``, each computed in one pass over the text.

    ``df`` has none of these columns yet; :func:`ledger` sees to that.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    w = "__ledger_words"
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    df = df.withColumn(w, words(F.col(text_col))).withColumn("__ledger_lines", lines)
    df = df.select(
        "*",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("__ledger_lines") - F.size(F.array_distinct("__ledger_lines"))).cast("long").alias("n_dup_lines"),
        F.size("__ledger_lines").cast("long").alias("n_lines"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))).cast("long").alias("n_letters"),
    ).drop("__ledger_lines")
    return _repeated_windows(df, w, "n_repeat_words").drop(w)


def ledger(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with the measures and the long ``failed``: bit *i* is set where rule *i* fails.

    A column that the input has already keeps its name and values; the ledger's column of
    that name gets underscores appended.
    """
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules at most")
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    own = (*MEASURES, "failed")
    aside = {c: f"__ledger_in_{i}" for i, c in enumerate(df.columns) if c.lower() in own}
    led = measure(df.withColumnsRenamed(aside), aside.get(text_col, text_col)).withColumn("failed", mask)
    return led.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in df.columns], *[F.col(n).alias(to) for n, to in zip(own, fresh(df, *own), strict=True)])


def passes(failed: Column, policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the policy failed."""
    return failed.bitwiseAND(F.lit(policy_mask(policy, rules)).cast("long")) == 0


def apply_policy(led: DataFrame, policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES, failed: str = "failed") -> DataFrame:
    """The rows that pass. The filter must stay above the ledger: pushed below it, the optimizer
    would write out the mask's whole expression wherever it refers to a step. A column that is
    not deterministic holds it there."""
    (stop,) = fresh(led, "__partition")
    return led.withColumn(stop, F.spark_partition_id()).where(passes(F.col(failed), policy, rules) & (F.col(stop) >= 0)).drop(stop)


def keep(df: DataFrame, policy: str | tuple[str, ...], text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that pass the policy, with its columns alone."""
    return apply_policy(ledger(df, text_col, rules), policy, rules, fresh(df, *MEASURES, "failed")[-1]).select(*[F.col(f"`{c}`") for c in df.columns])


def ablations(led: DataFrame, policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each rule of the policy: documents that fail it, that fail nothing else of the
    policy (dropping the rule lets these through), and the union/intersection of the failure masks
    of its documents. Documents are first counted by mask, so what is exploded is the handful of
    distinct masks and not the corpus."""
    mask = policy_mask(policy, rules)
    names = [(r.name, 1 << i) for i, r in enumerate(rules) if mask >> i & 1]
    by_mask = led.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    each = by_mask.select("m", "n", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in names])).alias("r"))
    hit = F.col("m").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only_this"),
        F.bit_or(F.when(hit, F.col("m"))).alias("any_failed"),
        F.bit_and(F.when(hit, F.col("m"))).alias("all_failed"),
    )


def versions(led: DataFrame, policies: dict[str, tuple[str, ...]] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """How many documents each policy version keeps and drops, from one count by mask."""
    masks = [(v, policy_mask(p, rules)) for v, p in (policies or POLICIES).items()]
    by_mask = led.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    each = by_mask.select("failed", "n", F.explode(F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(m).cast("long").alias("mask")) for v, m in masks])).alias("p"))
    ok = F.col("failed").bitwiseAND(F.col("p.mask")) == 0
    return each.groupBy(F.col("p.policy").alias("policy")).agg(
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("n_kept"), F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("n_dropped")
    )


def op10(docs: DataFrame, policy: str = "web-2") -> DataFrame:
    """The contract of ``op10_rule_ledger``: counts, ``base_failed`` and the policy's verdict."""
    led = ledger(docs.select("doc_id", "text"))
    base = led.failed.bitwiseAND(F.lit(policy_mask("base-1")).cast("long")) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes(led.failed, policy)).alias("kept"), "failed")


#: DuckDB twin of :func:`op10`. It lists words and windows with list functions; whole table, whole texts.
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)] AS win FROM w),
r AS (SELECT doc_id, t, ws, ls, win, list_sort(win) AS s FROM l),
d AS (SELECT *, list_distinct([s[i] for i in range(1, len(s)) if s[i] = s[i + 1]]) AS twice FROM r),
p AS (SELECT *, [i for i in range(1, len(win) + 1) if list_contains(twice, win[i])] AS hits FROM d),
c AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(len(list_distinct(flatten([[i, i + 1, i + 2] for i in hits]))), 0) AS n_repeat_words, len(ls) AS n_lines,
    length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS n_letters FROM p),
m AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 5 * n_symbols > n_words THEN 16 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 6 * n_lines THEN 32 ELSE 0 END)
    + (CASE WHEN n_letters >= 50 AND 10 * n_upper > 5 * n_letters THEN 64 ELSE 0 END) + (CASE WHEN 2 * n_letters < word_chars THEN 128 ELSE 0 END) AS failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed
FROM m
"""
