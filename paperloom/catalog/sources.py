"""S*: documents that Spark writes from the given tables and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.staging import shared_dir
from ..sources import documents as dc
from .nested import papers
from .registry import query


def _folder(r, name: str) -> str:
    return f"{shared_dir(r.spark)}/{name}-{uuid.uuid4().hex}"


@query("S1", """SELECT 'paper' AS part, CAST(paper_id AS VARCHAR) AS id, count(DISTINCT section_no) AS held, count(*) AS questions FROM v_questions GROUP BY paper_id
UNION ALL SELECT 'collection', 'c' || CAST(paper_id AS VARCHAR), 1, count(*) FROM v_questions GROUP BY paper_id""")
def _papers(r):
    whole = papers(r).withColumn("json", F.to_json(F.struct("id", "sections")))
    counted = whole.withColumn("n", F.aggregate("sections", F.lit(0), lambda n, s: n + F.size(s["questions"])))
    summary = F.array(F.struct("id", F.lit("").alias("title"), F.col("n").alias("question_count")))
    collection = F.to_json(F.struct(F.concat(F.lit("c"), "id").alias("id"), F.lit(dc.COLLECTION).alias("type"), summary.alias("papers")))
    # Beside each paper a copy that breaks off, which can't be read.
    lines = counted.select(F.explode(F.array("json", collection, F.substring("json", 1, 60))).alias("value"))
    path = _folder(r, "papers")
    lines.write.text(path)
    found, collections = dc.load_papers(r.spark, path, one_a_file=False)
    rows = found.select(F.lit("paper").alias("part"), "id", F.size("sections").cast("bigint").alias("held"), F.aggregate("sections", F.lit(0), lambda n, s: n + F.size(s["questions"])).cast("bigint").alias("questions"))
    return rows.unionByName(collections.select(F.lit("collection").alias("part"), "id", F.size("papers").cast("bigint").alias("held"), F.col("papers")[0]["question_count"].cast("bigint").alias("questions")))


@query("S2", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, page, text, extraction_method FROM v_ocr_pages")
def _pages(r):
    page = F.struct(F.col("page").cast("int").alias("page"), "text", F.lit(None).cast("string").alias("image"), "extraction_method")
    whole = r.v_ocr_pages.groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.collect_list(page).alias("pages"))  # a document is one JSON text by nature
    path = _folder(r, "ocr")
    dc.write_papers(whole, path)
    return dc.load_ocr_pages(r.spark, path, one_a_file=False).select("doc_id", F.col("page").cast("bigint").alias("page"), "text", "extraction_method")


@query("S3", """SELECT CASE WHEN is_legacy THEN 'legacy' ELSE md5(CAST(record_id AS VARCHAR)) END AS record_id, CAST(paper_id AS VARCHAR) AS paper_id, is_legacy, CASE WHEN notes IS NULL THEN 0 ELSE greatest(0, duration_seconds) END AS duration_seconds,
 CASE WHEN notes IS NULL THEN 0 ELSE 1 END AS notes, CASE WHEN n_attempts > 0 THEN 1 ELSE 0 END AS attempts FROM v_submissions""")
def _submissions(r):
    rows = r.v_submissions
    draft = F.when(F.col("notes").isNotNull(), F.struct(F.create_map(F.lit("q1"), "notes").alias("notes"), "duration_seconds"))
    attempts = F.when(F.col("n_attempts") > 0, F.array(F.struct(F.col("mtime").cast("timestamp").alias("submitted_at"))))
    own = F.when(~F.col("is_legacy"), F.upper(F.md5(F.col("record_id").cast("string"))))
    path = _folder(r, "submissions")
    rows.select(own.alias("record_id"), F.col("paper_id").cast("string").alias("paper_id"), draft.alias("draft"), attempts.alias("attempts")).write.json(path)
    read = dc.load_submissions(r.spark, path, one_a_file=False)
    return read.select(F.when(F.col("is_legacy"), "legacy").otherwise(F.col("record_id")).alias("record_id"), "paper_id", "is_legacy", "duration_seconds", F.size("notes").alias("notes"), F.size("attempts").alias("attempts"))


@query("S8", r"""WITH p AS (SELECT doc_id, page, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS n FROM v_ocr_pages)
SELECT 'page' AS part, doc_id, page AS number, n AS char_count, CASE WHEN n < 80 THEN 1 ELSE 0 END AS candidates FROM p UNION ALL SELECT 'document', doc_id, count(*), CAST(sum(n) AS BIGINT), count(*) FILTER (n < 80) FROM p GROUP BY doc_id""")
def _profile(r):
    pages, documents = dc.page_profile(r.v_ocr_pages, 80)
    rows = pages.select(F.lit("page").alias("part"), "doc_id", F.col("page").cast("bigint").alias("number"), "char_count", F.col("needs_ocr").cast("bigint").alias("candidates"))
    return rows.unionByName(documents.select(F.lit("document").alias("part"), "doc_id", F.col("page_count").alias("number"), F.col("text_char_count").alias("char_count"), F.col("ocr_candidates").alias("candidates")))


@query("S9", "SELECT paper_id, title, total_score, question_count FROM v_papers")
def _summaries(r):
    path = _folder(r, "collection")
    dc.write_papers(dc.paper_summaries(r.v_papers.drop("question_count").withColumn("total_score", F.col("total_score").cast("double")), r.v_questions), path)
    return r.spark.read.schema("paper_id long, title string, total_score double, question_count long").json(path)


@query("S10", """WITH s AS (SELECT *, '第一部分 词汇与结构' AS heading FROM v_questions WHERE type = 'single_choice'), n AS (SELECT paper_id, count(*) = 48 AS complete FROM s GROUP BY paper_id)
SELECT paper_id, section_no, number, heading, trim(stem) AS stem, complete FROM s JOIN n USING (paper_id)""")
def _sheet(r):
    sheet, counts = dc.choice_sheet(r.v_questions)
    return sheet.join(counts.select("paper_id", "complete"), "paper_id").select("paper_id", "section_no", "number", "heading", "stem", "complete")
