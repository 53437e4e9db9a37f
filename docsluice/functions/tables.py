"""Table functions that SQL can call: a text's chunks through LATERAL, a table's references with its own columns.

    register(spark)
    spark.sql("SELECT d.doc_id, c.* FROM documents d, LATERAL text_chunks(d.text) c")
    spark.sql("SELECT * FROM paper_references(TABLE(papers) PARTITION BY paper_id)")

The functions keep nothing between rows, so a table may be handed over by any partitioning, or none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, SelectedColumn, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..dims import CHUNK_CHARS, OVERLAP_CHARS
from ..operators.text import chunk_bounds
from .scalars import DOI

REFERENCE_LIST = re.compile(r"(?is)(?:^|\n)[ \t]*(?:references|bibliography)[ \t]*\n(.*)")
#: Longest reference, least length of one, and most of a text.
REFERENCE_CHARS, REFERENCE_LEAST, REFERENCES = 5_000, 20, 5_000


@udtf(returnType="idx int, start int, end int, chunk string")
class TextChunks:
    """text_chunks(text [, size [, overlap]]): the chunks of one text, as text.chunks makes them."""

    def eval(self, text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[tuple]:
        for idx, (start, end) in enumerate(chunk_bounds(text or "", size, overlap)):
            yield idx, start, end, text[start:end]


@udtf
class PaperReferences:
    """paper_references(TABLE(papers)): (paper_id, id, raw, doi) of the entries after a line that says references or bibliography.

    The table needs paper_id, of any type, and text; only these two columns are read.
    """

    @staticmethod
    def analyze(papers: AnalyzeArgument) -> AnalyzeResult:
        columns = {f.name: f.dataType for f in papers.dataType.fields} if papers.isTable else {}
        if not {"paper_id", "text"} <= set(columns):
            raise ValueError("paper_references reads a table with the columns paper_id and text")
        out = StructType([StructField("paper_id", columns["paper_id"]), StructField("id", StringType()), StructField("raw", StringType()), StructField("doi", StringType())])
        return AnalyzeResult(schema=out, select=[SelectedColumn("paper_id"), SelectedColumn("text")])

    def eval(self, row: Row) -> Iterator[tuple]:
        found = REFERENCE_LIST.search(row["text"] or "")
        if not found:
            return
        entries = (re.sub(r"[ \t\n\x0b\f\r]+", " ", x).strip(" ") for x in re.split(r"\n[ \t\n\x0b\f\r]*\n", found[1]))
        for k, raw in enumerate([x for x in entries if len(x) > REFERENCE_LEAST][:REFERENCES]):
            doi = re.search(DOI, raw[:REFERENCE_CHARS])
            yield row["paper_id"], f"ref-{k + 1}", raw[:REFERENCE_CHARS], doi[1].rstrip(".,;)]").lower() if doi else None


@udtf
class PageText:
    """page_text(TABLE(items) PARTITION BY paper_id ORDER BY (page, pos)): items with their start and end in the paper's text.

    The one function here that goes on from row to row: Spark hands it a paper at a time, in order.
    """

    @staticmethod
    def analyze(items: AnalyzeArgument) -> AnalyzeResult:
        columns = {f.name: f for f in items.dataType.fields}
        return AnalyzeResult(schema=StructType([columns["paper_id"], columns["page"], columns["pos"], StructField("start", IntegerType()), StructField("end", IntegerType())]))

    def __init__(self) -> None:
        self.at = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        text = row["str"] or ""
        if text.strip(" "):
            yield row["paper_id"], row["page"], row["pos"], self.at, self.at + len(text)
            self.at += len(text) + 1


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for name, function in (("text_chunks", TextChunks), ("paper_references", PaperReferences), ("page_text", PageText)):
        spark.udtf.register(name, function)
