"""Getting papers in: validation, names, deduplication, upserts, defaults, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradloom.functions.rewrite import Sub, rewrite, strip
from gradloom.functions.text import MONTHS

MIN_BYTES, MAX_BYTES = 1024, 50 * 1024 * 1024
#: What names a month in a file name, in the order of the search. Found as part of any word.
MONTH_KEYS = (("january", 0), ("jan", 0), ("february", 1), ("feb", 1), ("march", 2), ("mar", 2), ("april", 3), ("apr", 3), ("may", 4), ("june", 5), ("jun", 5), ("july", 6), ("jul", 6), ("august", 7), ("aug", 7),
              ("september", 8), ("sep", 8), ("sept", 8), ("october", 9), ("oct", 9), ("november", 10), ("nov", 10), ("december", 11), ("dec", 11))


def validate_pdf(name: Column, size: Column, head: Column) -> Column:
    """The first rule that a file breaks, else ``Valid``: suffix, magic bytes, least and greatest size."""
    return (
        F.when(~F.lower(name).endswith(".pdf"), "File must be a .pdf").when(head != "%PDF-", "Not a valid PDF header").when(size < MIN_BYTES, "File too small").when(size > MAX_BYTES, "File exceeds 50MB").otherwise("Valid")
    )


def parse_filename(name: Column) -> tuple[Column, Column, Column]:
    """(title, year, exam type) of a file name."""
    stem = F.regexp_replace(name, r"\.[^.]*\z", "")
    year = F.nullif(F.regexp_extract(stem, r"(20\d{2})", 1), F.lit(""))
    low, month = F.lower(stem), None
    for key, i in MONTH_KEYS:
        month = F.when(low.contains(key), MONTHS[i]) if month is None else month.when(low.contains(key), MONTHS[i])
    title = F.when(year.isNull(), stem).otherwise(strip(F.replace(stem, year, F.lit(""))))
    for key, _ in MONTH_KEYS:
        title = F.regexp_replace(title, rf"(?i)\b{key}\b", "")
    title = rewrite(title, (Sub(r"[,_\-]+\s*\z"), Sub(r"\A\s+|\s+\z"), Sub(r"\s+", " "), Sub(r"\A\s+|\s+\z")))
    kind = F.when(month.isNotNull() & year.isNotNull(), F.concat_ws(" ", month, year)).otherwise(F.coalesce(month, year))
    return F.coalesce(F.nullif(title, F.lit("")), name), year, kind


def new_uploads(uploads: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Uploads that are not stored yet, one for each key."""
    return uploads.dropDuplicates(list(key)).join(stored.select(*key), list(key), "left_anti")


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def fill_empty(old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A re-run's merge: known keys keep what they have and take what they lack; new keys come in."""
    n = new.select(*key, *[F.col(c).alias(f"__new_{c}") for c in columns])
    return old.join(n, list(key), "full").select(*key, *[F.coalesce(F.nullif(F.col(c), F.lit("").cast(old.schema[c].dataType)) if dict(old.dtypes)[c] == "string" else F.col(c), F.col(f"__new_{c}")).alias(c) for c in columns])


def default_modules(subjects: DataFrame, modules: DataFrame) -> DataFrame:
    """Five modules of weight 20 for each subject that has none."""
    bare = subjects.select("subject_id").distinct().join(modules.select("subject_id"), "subject_id", "left_anti")
    return bare.select("subject_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("module_number")).select("subject_id", "module_number", F.concat(F.lit("Module "), F.col("module_number").cast("string")).alias("module_name"), F.lit(20.0).alias("weightage"))


def valid_rows(text: Column, marks: Column) -> Column:
    """Marks positive if given, five characters of text at least."""
    return (marks.isNull() | (marks > 0)) & (F.length(strip(F.coalesce(text, F.lit("")))) >= 5)


def layer_quality(chars: Column, pages: Column, artifacts: Column) -> Column:
    """``image`` below 50 characters a page, ``dirty`` above 0.4 artefacts in 100 characters, else ``clean``."""
    return F.when((F.coalesce(pages, F.lit(0)) == 0) | (chars / pages < 50), "image").when(artifacts * 100.0 / chars > 0.4, "dirty").otherwise("clean")
