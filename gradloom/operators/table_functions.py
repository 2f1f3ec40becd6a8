"""Table functions for SQL: the segmenter over pages, partitioned by paper."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SkipRestOfInputTableException

from gradloom.operators.segment import SCHEMA, parse
from gradloom.workers import ship

MOST_CHARS = 2_000_000
#: Where calls are analysed there is no session that could read a schema.
_KINDS = {"int": IntegerType(), "string": StringType(), "boolean": BooleanType(), "array<string>": ArrayType(StringType())}


class SegmentPages:
    """``segment_pages(TABLE (pages), joint => '\\n')``: questions of papers given as pages (paper_id, page, text).

    The call states neither partitioning nor order: the function asks for its pages by paper, in order. A paper's pages are put together
    with ``joint`` and cut into questions when the last one is there; a paper of more than ``MOST_CHARS`` characters is cut off there,
    with a last row that says so.
    """

    @staticmethod
    def analyze(pages: AnalyzeArgument, joint: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not pages.isTable:
            raise ValueError("segment_pages wants a table: segment_pages(TABLE (SELECT paper_id, page, text ...))")
        have = {f.name: f.dataType for f in pages.dataType.fields}
        if missing := [c for c in ("paper_id", "page", "text") if c not in have]:
            raise ValueError(f"segment_pages wants the columns paper_id, page and text; not there: {', '.join(missing)}")
        if joint is not None and (not joint.isConstantExpression or joint.dataType != StringType()):
            raise ValueError("joint is a constant string")
        out = StructType().add("paper_id", have["paper_id"])
        for column in SCHEMA.split(", ")[1:]:
            name, kind = column.split()
            out = out.add(name, _KINDS[kind])
        return AnalyzeResult(schema=out.add("pages", IntegerType()), partitionBy=[PartitioningColumn("paper_id")], orderBy=[OrderingColumn("page"), OrderingColumn("text")])

    def __init__(self) -> None:
        self.paper, self.joint, self.pages, self.size = None, "\n", [], 0

    def eval(self, page: Row, joint: str | None = None) -> Iterator[tuple]:
        self.paper, self.joint = page["paper_id"], "\n" if joint is None else joint
        if self.size > MOST_CHARS:
            raise SkipRestOfInputTableException
        self.pages.append(page["text"] or "")
        self.size += len(self.pages[-1])
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        if not self.pages:
            return
        for i, q in enumerate(parse(self.joint.join(self.pages)[:MOST_CHARS])):
            yield self.paper, i, q.number, q.text, q.full_text, q.part, q.marks, q.subs, q.module, q.explicit, q.session, q.group, len(self.pages)
        if self.size > MOST_CHARS:
            yield self.paper, -1, None, f"cut off at {MOST_CHARS} characters", None, None, None, None, None, None, None, None, len(self.pages)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    ship(spark)
    spark.udtf.register("segment_pages", udtf(SegmentPages))
