"""Stored documents in and out: papers, collections, page texts and submissions as JSON.

Schemas are given, so nothing is inferred and only the columns that a query asks for are parsed. A
document that can't be read is left out. ``one_a_file`` tells folders of documents, each over many lines,
from files with a document a line, which Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from .schemas import OCR_DOCUMENT, PAPER, SUBMISSION

COLLECTION = "paper_collection"
# What a sheet of choices is called by the start of its section's title, and the number it has.
SHEET_HEADING = ("Part I", "第一部分 词汇与结构")
SHEET_OTHER = "选择题"
SHEET_QUESTIONS = 48
_BROKEN = "_unread"


def _documents(spark: SparkSession, path: str, schema: str, one_a_file: bool) -> DataFrame:
    reader = spark.read.schema(f"{schema},{_BROKEN} string").option("columnNameOfCorruptRecord", _BROKEN).option("multiLine", one_a_file)
    return reader.json(path).filter(F.col(_BROKEN).isNull())


def load_papers(spark: SparkSession, path: str, one_a_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """(papers, collections). A document without an id is left out."""
    whole = _documents(spark, path, PAPER, one_a_file).drop(_BROKEN).filter("id IS NOT NULL")
    is_collection = F.coalesce(F.col("type") == COLLECTION, F.lit(False))
    return whole.filter(~is_collection).drop("papers"), whole.filter(is_collection).select("id", "title", "superseded_by", "source", "papers")


def load_ocr_pages(spark: SparkSession, path: str, one_a_file: bool = True) -> DataFrame:
    """``doc_id, file_name, page, text, image, extraction_method``, one row a page."""
    whole = _documents(spark, path, OCR_DOCUMENT, one_a_file).filter("id IS NOT NULL")
    return whole.select(F.col("id").alias("doc_id"), "source.file_name", F.inline("pages"))


def load_submissions(spark: SparkSession, path: str, one_a_file: bool = True) -> DataFrame:
    """Submissions with their defaults: record_id, paper_id, title, answers, categories, notes, marks, duration_seconds,
    draft_at, attempts, is_legacy, mtime. A record whose id isn't 32 hexadecimal digits is a legacy one, named after
    its file; ``mtime`` is the file's time."""
    whole = _documents(spark, path, SUBMISSION, one_a_file)
    own = F.lower(F.coalesce("record_id", F.lit("")))
    legacy = ~own.rlike("^[0-9a-f]{32}$")
    stem = F.regexp_replace(F.regexp_replace(F.try_url_decode(F.col("_metadata.file_name")), r"\.[^.]*$", ""), "[^A-Za-z0-9_-]", "")
    empty = lambda c, kind: F.coalesce(F.col(c), F.lit(None).cast(kind), F.from_json(F.lit("[]" if kind.startswith("array") else "{}"), kind))
    return whole.select(
        F.when(legacy, F.concat(F.lit("legacy-"), stem)).otherwise(own).alias("record_id"), "paper_id", F.coalesce("title", F.lit("")).alias("title"),
        empty("draft.answers", "map<string,array<string>>").alias("answers"), empty("draft.categories", "map<string,array<string>>").alias("categories"),
        empty("draft.notes", "map<string,string>").alias("notes"), empty("draft.marks", "array<string>").alias("marks"),
        F.greatest(F.lit(0), F.coalesce("draft.duration_seconds", F.lit(0))).alias("duration_seconds"), F.col("draft.updated_at").alias("draft_at"),
        F.coalesce("attempts", F.array().cast(whole.schema["attempts"].dataType)).alias("attempts"), legacy.alias("is_legacy"), F.col("_metadata.file_modification_time").alias("mtime"),
    )


def page_profile(pages: DataFrame, min_chars: int = 20) -> tuple[DataFrame, DataFrame]:
    """(pages, documents). Pages: doc_id, page, char_count, needs_ocr; a page with fewer than ``min_chars`` characters
    has to be recognised from its image. Documents: doc_id, page_count, text_char_count, ocr_candidates. Null texts
    are empty."""
    text = tx.strip(F.regexp_replace(F.coalesce("text", F.lit("")), "\x00", ""))
    profiled = pages.select("doc_id", "page", F.length(text).cast("bigint").alias("char_count")).withColumn("needs_ocr", F.col("char_count") < min_chars)
    documents = profiled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"), F.sum("char_count").alias("text_char_count"), F.count_if("needs_ocr").alias("ocr_candidates"))
    return profiled, documents


def paper_summaries(papers: DataFrame, questions: DataFrame) -> DataFrame:
    """``paper_id, title, total_score, question_count``: what a collection says of each of its papers. A paper without
    questions has 0. ``questions``: paper_id, one row each."""
    counts = questions.groupBy("paper_id").agg(F.count(F.lit(1)).alias("question_count"))
    return papers.select("paper_id", "title", "total_score").join(counts, "paper_id", "left").withColumn("question_count", F.coalesce("question_count", F.lit(0)))


def write_papers(papers: DataFrame, path: str) -> None:
    """Paper documents as JSON, one a line, in place of what is there; nulls are kept apart from what is missing."""
    papers.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def choice_sheet(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sheet, counts). Sheet: paper_id, section_no, number, heading, stem, and the other columns of ``questions`` that
    are of one choice. Every title that starts with ``Part I``, so also those of parts II to IV, has the first
    part's heading; others have their own. Counts: paper_id, questions, complete. Order the sheet by paper_id,
    section_no, number."""
    start, first = SHEET_HEADING
    title = F.coalesce("section_title", F.lit(""))
    heading = F.when(title.startswith(start), first).when(title != "", title).otherwise(SHEET_OTHER)
    sheet = questions.filter("type = 'single_choice'").withColumns({"heading": heading, "stem": tx.strip(F.coalesce("stem", F.lit("")))})
    counts = sheet.groupBy("paper_id").agg(F.count(F.lit(1)).alias("questions"))
    return sheet, counts.withColumn("complete", F.col("questions") == SHEET_QUESTIONS)
