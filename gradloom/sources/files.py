"""Files as tables: uploaded documents, page extraction, reports and exports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradloom.lineage import cut
from gradloom.operators.ingest import validate_pdf
from gradloom.workers import batches_of, ship

PAGES = "path string, page_number int, text string, confidence double, method string"
Extractor = Callable[[bytes], list[tuple[str, float]]]


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Each file with its hash and the verdict of validation; the content stays in its column."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.substring_index("path", "/", -1)
    head = F.substring("content", 1, 5).cast("string")
    return files.select("path", name.alias("name"), "length", F.sha2("content", 256).alias("file_hash"), validate_pdf(name, F.col("length"), head).alias("verdict"), "content")


def plain_text(data: bytes) -> list[tuple[str, float]]:
    """Pages of a text file, divided by form feeds."""
    return [(p, 1.0) for p in data.decode("utf-8", "replace").split("\f")]


#: Files are whole in memory: a batch ends with the file that fills its bytes. Pages of small files leave together.
FILES_A_BATCH, BYTES_A_BATCH, PAGES_A_BATCH = 1024, 4 << 20, 1024


def _batch(pages: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pages, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PAGES.split(", ")])


def extract_pages(files: DataFrame, cascade: list[tuple[str, Extractor]], least_chars: int = 0, each: int | None = None) -> DataFrame:
    """Pages of each file by the first extractor of the cascade that gives more than ``least_chars`` characters (``each``: by
    the stage's own pages, that many on average).

    A file on which all stages fail is one row: page 0, no text, confidence 0, method ``failed`` with each stage's reason; see
    :func:`failed` and :func:`required`. Files are read once, when this is called, in batches bounded by ``BYTES_A_BATCH``, as each file is whole in memory.
    """

    def read(data: bytes | None) -> tuple[str, list[tuple[str, float]]]:
        said = []
        for method, extract in cascade:
            try:
                pages = extract(data or b"")
            except Exception as e:  # each library fails in its own way; the next one is tried
                said.append(f"{method}: {type(e).__name__}")
                continue
            chars = sum(len((t or "").strip()) for t, _ in pages)
            if chars > least_chars and (each is None or chars >= each * len(pages)):
                return method, pages
            said.append(f"{method}: {chars} characters")
        return "failed (" + ", ".join(said) + ")", []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, chars = [], 0
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                method, pages = read(data.as_py())
                found += [(path, i, t, c, method) for i, (t, c) in enumerate(pages, 1)] or [(path, 0, None, 0.0, method)]
                chars += sum(len(t or "") for t, _ in pages)
                if len(found) >= PAGES_A_BATCH or chars >= BYTES_A_BATCH:
                    yield _batch(found)
                    found, chars = [], 0
            if found:
                yield _batch(found)

    ship(files.sparkSession)
    with batches_of(files.sparkSession, FILES_A_BATCH, BYTES_A_BATCH):  # written at once: the bound holds for jobs that run in here
        return cut(files.select("path", "content").mapInArrow(run, PAGES), "pages")


def failed(pages: DataFrame) -> DataFrame:
    """``path, reason`` of the files that no stage could read."""
    return pages.where("page_number = 0").select("path", F.col("method").alias("reason"))


def required(pages: DataFrame) -> DataFrame:
    """The pages of files that were read; raises if there is one that wasn't."""
    bad = failed(pages).limit(5).collect()
    if bad:
        raise ValueError("no text in " + "; ".join(f"{r['path']}: {r['reason']}" for r in bad))
    return pages.where("page_number > 0")


def papers_text(pages: DataFrame, joint: str = "\n\n") -> DataFrame:
    """The pages of each paper joined in order; a paper's pages are a bounded group. A file that couldn't be read has no pages and an empty text."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return pages.groupBy("path").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), joint).alias("text"), F.count("text").alias("page_count"), F.avg("confidence").alias("confidence"))


def export_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def write_json(df: DataFrame, folder: str) -> None:
    """Rows as JSON lines, what the status and chart APIs serve."""
    df.write.mode("overwrite").json(folder)


def replace_partitions(df: DataFrame, folder: str, by: list[str]) -> None:
    """Replace-all refresh: the partitions that ``df`` has are overwritten, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)
