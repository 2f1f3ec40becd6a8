"""Merges that see what changes: rows updated or created by key, and edits whose marks stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradloom.functions.classify import tier, tier_label


def update_or_create(known: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``key, columns, state``: rows of ``new`` replace those of ``known`` with their key, others stay; ``state`` says which were
    ``created``, ``updated``, ``unchanged`` (nothing differs, nulls are equal) or ``kept`` (not in ``new``). Keys are one row each."""
    old = known.select(*key, F.struct(*columns).alias("__old"))
    fresh = new.select(*key, F.struct(*columns).alias("__new"))
    both = old.join(fresh, list(key), "full")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"__old.{c}").eqNullSafe(F.col(f"__new.{c}"))
    state = F.when(F.col("__new").isNull(), "kept").when(F.col("__old").isNull(), "created").when(same, "unchanged").otherwise("updated")
    now = F.coalesce("__new", "__old")
    return both.select(*key, *[now[c].alias(c) for c in columns], state.alias("state"))


def assign_priorities(known: DataFrame, groups: DataFrame) -> DataFrame:
    """``cluster_id, tier, tier_label, frequency, state``: the tiers of clusters that repeat a question, updated or created; a
    concept cluster never has one, and one that it has from before goes. Assignments of clusters that aren't in ``groups`` stay."""
    strict = groups.where("cluster_type = 'strict_repetition'")
    concept = groups.where("cluster_type = 'concept_similarity'").select("cluster_id")
    new = strict.select("cluster_id", tier(F.col("frequency")).alias("tier"), "frequency").withColumn("tier_label", tier_label(F.col("tier")))
    return update_or_create(known.join(concept, "cluster_id", "left_anti"), new, ["cluster_id"], ["tier", "tier_label", "frequency"])


def apply_edits(rows: DataFrame, edits: DataFrame, key: str, order: Sequence[str], sticky: dict[str, str], verified: str | None = None) -> DataFrame:
    """``rows`` after ``edits`` (key, ``order``, the columns of ``sticky``): what each form held, one after the other.

    ``sticky`` maps a column to the flag that says it was set by hand. The flag is set where an edit has another value than
    the row had just then, nulls being values, and never taken back: setting a value and setting it back sets the flag, sending a form as it
    was doesn't. With ``verified`` (a flag column of ``edits``) an edit that holds it sets the first flag without a change.
    Applying the same edits again changes nothing. Edits of keys that ``rows`` hasn't are left out.
    """
    w = Window.partitionBy(key).orderBy(*order)
    start = rows.select(key, *[F.col(c).alias(f"__{c}") for c in sticky])
    told = edits.select(key, *order, *sticky, F.coalesce(F.col(verified), F.lit(False)).alias("__seen") if verified else F.lit(False).alias("__seen")).join(start, key)
    first = F.row_number().over(w) == 1
    marks = {c: F.when(first, ~F.col(c).eqNullSafe(F.col(f"__{c}"))).otherwise(~F.col(c).eqNullSafe(F.lag(c).over(w))) for c in sticky}
    told = told.withColumns({f"__changed_{c}": m for c, m in marks.items()})
    last = told.groupBy(key).agg(F.max_by(F.struct(*sticky), F.struct(*order)).alias("__last"), *[F.bool_or(f"__changed_{c}").alias(f"__changed_{c}") for c in sticky], F.bool_or("__seen").alias("__seen"))
    out = rows.join(last, key, "left")
    for i, (c, flag) in enumerate(sticky.items()):
        now = F.coalesce(F.col(flag), F.lit(False)) | F.coalesce(F.col(f"__changed_{c}"), F.lit(False))
        out = out.withColumn(c, F.when(F.col("__last").isNotNull(), F.col(f"__last.{c}")).otherwise(F.col(c))).withColumn(flag, now | F.coalesce("__seen", F.lit(False)) if not i else now)
    return out.drop("__last", "__seen", *[f"__changed_{c}" for c in sticky])


def reclassified(rows: DataFrame, computed: DataFrame, key: str, sticky: dict[str, str]) -> DataFrame:
    """``rows`` with the values that a new run ``computed`` (key and the columns of ``sticky``), except those set by hand."""
    new = computed.select(key, F.struct(*sticky).alias("__new"))
    out = rows.join(new, key, "left")
    for c, flag in sticky.items():
        out = out.withColumn(c, F.when(F.col("__new").isNotNull() & ~F.coalesce(F.col(flag), F.lit(False)), F.col(f"__new.{c}")).otherwise(F.col(c)))
    return out.drop("__new")
