"""Generation jobs: state from their events, progress, what a repair can reuse and what it changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .pages import page_windows

# Statuses of jobs at work, issue codes that no page can mend, and statuses of papers by rank.
ACTIVE = ["queued", "running"]
NO_REPAIR = ["unconfirmed_format", "no_source"]
RANKS = {"incomplete": 2, "review": 1}
CURRENT_METHOD = "vision_ocr"


def job_state(events: DataFrame) -> DataFrame:
    """``job_id, status, stage, done, total, stages`` after a job's last event; ``done`` and ``total`` are those of
    its stage, ``stages`` counts the stages it has reached. A job at work that no worker runs is
    ``interrupted``. ``events``: job_id, event_id, ts, stage, status, done, total, live; order is by ``ts``,
    then ``event_id``."""
    at = F.struct("ts", "event_id")
    last = events.groupBy("job_id").agg(F.max_by(F.struct("status", "stage", "done", "total", "live"), at).alias("e"), F.count_distinct("stage").alias("stages"))
    lost = F.col("e.status").isin(*ACTIVE) & ~F.coalesce("e.live", F.lit(False))
    return last.select("job_id", F.when(lost, "interrupted").otherwise(F.col("e.status")).alias("status"), "e.stage", "e.done", "e.total", "stages")


def recent_jobs(jobs: DataFrame, results: DataFrame, hidden: DataFrame, shown: int = 20) -> DataFrame:
    """``job_id, updated_at`` of the ``shown`` newest jobs (ties: the larger id), less those whose papers are all
    hidden, so fewer may be left. ``jobs``: job_id, updated_at; ``results``: job_id, item_id. The newest are
    few, so results are reduced to theirs first."""
    newest = jobs.select("job_id", "updated_at").orderBy(F.desc("updated_at"), F.desc("job_id")).limit(shown)
    own = results.join(newest.select("job_id"), "job_id", "left_semi")
    flagged = own.join(hidden.select("item_id", F.lit(True).alias("hid")).distinct(), "item_id", "left")
    gone = flagged.groupBy("job_id").agg(F.min(F.coalesce("hid", F.lit(False))).alias("gone")).filter("gone")
    return newest.join(gone, "job_id", "left_anti")


def job_outcome(papers: DataFrame) -> DataFrame:
    """``job_id, status``: the worst of its papers' statuses. ``papers``: job_id, status; statuses that are neither
    incomplete nor review, nulls too, count as completed."""
    rank = F.when(F.col("status") == "incomplete", RANKS["incomplete"]).when(F.col("status") == "review", RANKS["review"]).otherwise(0)
    worst = papers.groupBy("job_id").agg(F.max(rank).alias("rank"))
    name = F.when(F.col("rank") == RANKS["incomplete"], "incomplete").when(F.col("rank") == RANKS["review"], "review").otherwise("completed")
    return worst.select("job_id", name.alias("status"))


def extract_progress(pages: DataFrame, cached: DataFrame, standard: DataFrame) -> DataFrame:
    """``doc_id, done, total, standard_papers``: windows that are read already, of all that have to be. A document
    of ``standard`` needs none. ``pages``: doc_id, page; ``cached``: doc_id, window_no; ``standard``: doc_id."""
    windows = page_windows(pages).select("doc_id", "window_no").distinct()
    flagged = windows.join(cached.select("doc_id", "window_no", F.lit(1).alias("held")).distinct(), ["doc_id", "window_no"], "left")
    counts = flagged.groupBy("doc_id").agg(F.count("held").alias("done"), F.count(F.lit(1)).alias("total"))
    plain = counts.join(standard.select("doc_id", F.lit(1).alias("is_standard")).distinct(), "doc_id", "left")
    none = F.col("is_standard").isNotNull()
    return plain.select("doc_id", F.when(none, 0).otherwise(F.col("done")).alias("done"), F.when(none, 0).otherwise(F.col("total")).alias("total"), none.cast("bigint").alias("standard_papers"))


def repair_plan(chunks: DataFrame, issues: DataFrame) -> DataFrame:
    """``paper_id, chunk, reused``: whether a repair keeps an extracted chunk. A paper without issues, or with one
    that names no page, is read again as a whole; else a chunk is kept if none of its pages has an issue.

    ``chunks``: paper_id, chunk, page, one row for each page; ``issues``: paper_id, code, page (null: none)."""
    counted = issues.filter(~F.col("code").isin(*NO_REPAIR))
    papers = counted.groupBy("paper_id").agg(F.max(F.col("page").isNull()).alias("pageless"))
    bad = counted.filter("page IS NOT NULL").select("paper_id", "page", F.lit(True).alias("bad")).distinct()
    touched = chunks.select("paper_id", "chunk", "page").join(bad, ["paper_id", "page"], "left")
    held = touched.groupBy("paper_id", "chunk").agg(F.max(F.coalesce("bad", F.lit(False))).alias("bad"))
    whole = F.coalesce("pageless", F.lit(True))
    return held.join(papers, "paper_id", "left").select("paper_id", "chunk", (~whole & ~F.col("bad")).alias("reused"))


def paper_changed(original: DataFrame, corrected: DataFrame, submissions: DataFrame) -> DataFrame:
    """``paper_id, changed, separate, target_id`` of every corrected paper. Changed: its questions differ in title
    of section, id, number, stem or options, or in order. Separate: it is changed or has a submission, and is
    stored beside the original.

    ``original`` and ``corrected``: paper_id, place, signature (any columns that must agree, as a struct);
    ``submissions``: paper_id. Rows meet by place, so no paper is gathered into one row."""
    keys = ["paper_id", "place"]
    # Both sides in one shuffle: a place that agrees has the same signature from either side.
    both = original.select(*keys, F.lit(0).alias("side"), "signature").unionByName(corrected.select(*keys, F.lit(1).alias("side"), "signature"))
    digest = F.sha2(F.to_json("signature", {"ignoreNullFields": "false"}), 256)
    placed = both.groupBy(*keys).agg(F.max(F.when(F.col("side") == 0, digest)).alias("old"), F.max(F.when(F.col("side") == 1, digest)).alias("new"))
    papers = placed.groupBy("paper_id").agg(F.max(~F.col("old").eqNullSafe(F.col("new"))).alias("changed"), F.count("new").alias("n"))
    sent = submissions.select("paper_id", F.lit(True).alias("sent")).distinct()
    judged = papers.filter("n > 0").join(sent, "paper_id", "left").withColumn("separate", F.col("changed") | F.coalesce("sent", F.lit(False)))
    target = F.concat(F.col("paper_id").cast("string"), F.when(F.col("separate"), "-r").otherwise(""))
    return judged.select("paper_id", "changed", "separate", target.alias("target_id"))


def stale_ocr_pages(pages: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages to read again, chunks that stay). A page that wasn't read by the current method is read again, and
    then no chunk of its document holds. ``pages``: doc_id, page, extraction_method; ``chunks``: doc_id, …"""
    stale = pages.filter(~F.col("extraction_method").eqNullSafe(F.lit(CURRENT_METHOD))).select("doc_id", "page")
    return stale, chunks.join(stale.select("doc_id").distinct(), "doc_id", "left_anti")
