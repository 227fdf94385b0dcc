"""Deterministic grading of all attempts in one job.

Items are rows ``attempt_id, paper_id, question_id, number, type, answer_key,
student_answer`` (plus ``max_score`` once section scores are joined).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..functions.answers import OBJECTIVE_TYPES, has_answer, money, normalize_answer, ratio

ITEM = ["attempt_id", "paper_id", "question_id"]
RECORD = ["attempt_id", "paper_id"]

# Stored result texts.
REASON_RIGHT = "答案正确。"
REASON_WRONG = "答案与标准答案不一致。"
REASON_UNANSWERED = "未作答，未调用 AI 判卷。"
REASON_MANUAL = "未能完成 AI 判卷，请人工复核。"


def answer_lookup(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Answer stored under the question id, else under the number.

    ``answers``: ``attempt_id, paper_id, answer_name, answer``. A blank answer stored under
    the id still wins over the one under the number.
    """
    stored = answers.select(*RECORD, "answer_name", F.struct("answer").alias("hit"))
    by_id = stored.withColumnRenamed("answer_name", "question_id").withColumnRenamed("hit", "id_hit")
    by_number = stored.withColumnRenamed("answer_name", "number_name").withColumnRenamed("hit", "number_hit")
    return (
        items.withColumn("number_name", F.col("number").cast("string"))
        .join(by_id, ITEM, "left")
        .join(by_number, [*RECORD, "number_name"], "left")
        .select(
            *ITEM,
            F.when(F.col("id_hit").isNotNull(), F.col("id_hit.answer"))
            .otherwise(F.col("number_hit.answer"))
            .alias("student_answer"),
        )
    )


def normalize_answers(items: DataFrame) -> DataFrame:
    """Canonical answers, parts joined by ``|``."""
    return items.select(
        *ITEM,
        F.array_join(normalize_answer(F.col("student_answer")), "|").alias("submitted"),
        F.array_join(normalize_answer(F.col("answer_key")), "|").alias("expected"),
    )


def can_grade() -> Column:
    keyed = F.col("answer_key").isNotNull() & (F.col("answer_key") != "")
    return keyed & F.col("type").isin(*OBJECTIVE_TYPES)


def answered_flags(items: DataFrame) -> DataFrame:
    return items.select(*ITEM, has_answer(F.col("student_answer")).alias("answered"))


def route_items(items: DataFrame) -> DataFrame:
    """Answered items with their routes; an item with a key and options goes to both."""
    return (
        items.filter(has_answer(F.col("student_answer")))
        .withColumn("objective", can_grade())
        .withColumn("to_scorer", ~F.col("objective") | F.col("has_options"))
    )


def item_scores(items: DataFrame, sections: DataFrame) -> DataFrame:
    """Join the score of one question: the section's, else its total over its questions."""
    score = F.when(F.col("score") > 0, money(F.col("score"))).otherwise(
        ratio(F.col("total_score"), F.col("n_questions"))
    )
    per_question = sections.select("paper_id", "section_no", score.alias("max_score"))
    # An item without a section row keeps its place and has no score to win.
    return items.join(per_question, ["paper_id", "section_no"], "left").withColumn("max_score", F.coalesce("max_score", money(F.lit(0))))


def _key_matches() -> Column:
    key = normalize_answer(F.col("answer_key"))
    return (F.size(key) > 0) & (key == normalize_answer(F.col("student_answer")))


def grade_objective(items: DataFrame) -> DataFrame:
    """Full score or none for every answered item with a key."""
    correct = _key_matches()
    return (
        route_items(items)
        .filter("objective")
        .select(
            *ITEM,
            correct.alias("is_correct"),
            F.when(correct, F.col("max_score")).otherwise(money(F.lit(0))).cast("double").alias("score_awarded"),
        )
    )


def scorer_batches(items: DataFrame, size: int = 12) -> DataFrame:
    """Batches of a record's scorer items with the number of items and their contexts.

    A record holds each question of one paper once, so its window is bounded by the paper.
    """
    order = Window.partitionBy(*RECORD).orderBy("number", "question_id")
    return (
        route_items(items)
        .filter("to_scorer")
        .withColumn("batch", F.floor((F.row_number().over(order) - 1) / size))
        .groupBy(*RECORD, "batch")
        .agg(
            F.count("*").alias("items"),
            F.array_join(F.array_sort(F.collect_set("context_key")), ",").alias("materials"),
        )
    )


def accept_scorer_results(raw: DataFrame, items: DataFrame) -> DataFrame:
    """Results for known scorer items only; the last one (``seq``) per question wins."""
    known = route_items(items).filter("to_scorer").select(*ITEM)
    fields = [c for c in raw.columns if c not in (*ITEM, "seq")]
    return (
        raw.join(known, ITEM)
        .groupBy(*ITEM)
        .agg(F.max_by(F.struct(*fields), "seq").alias("r"))
        .select(*ITEM, "r.*")
    )


def order_option_analysis(analysis: DataFrame, options: DataFrame) -> DataFrame:
    """First supplied analysis per real option, placed in source option order.

    ``analysis``: item keys, ``option_id, explanation, seq``; ``options``: item keys,
    ``option_index, option_id``.
    """
    first = (
        analysis.withColumn("option_id", tx.strip(F.col("option_id")))
        .filter(F.col("option_id") != "")
        .groupBy(*ITEM, "option_id")
        .agg(F.min_by(tx.strip(F.coalesce(F.col("explanation"), F.lit(""))), "seq").alias("explanation"))
    )
    return options.join(first, [*ITEM, "option_id"]).select(*ITEM, "option_index", "option_id", "explanation")


def merge_results(items: DataFrame, scored: DataFrame) -> DataFrame:
    """One result per item. A key decides; the scorer may only add its reason when it agrees."""
    s = scored.select(
        *ITEM,
        F.col("is_correct").alias("s_correct"),
        F.col("score_awarded").alias("s_score"),
        F.col("correct_answer").alias("s_answer"),
        F.col("reason").alias("s_reason"),
        F.lit(True).alias("s_hit"),
    )
    rows = (
        items.join(s, ITEM, "left")
        .withColumn("answered", has_answer(F.col("student_answer")))
        .withColumn("objective", F.col("answered") & can_grade())
        .withColumn(
            "scored",
            F.col("s_hit").isNotNull() & F.col("answered") & (~F.col("objective") | F.col("has_options")),
        )
        .withColumn("right", _key_matches())
    )
    agrees = (
        F.col("scored")
        & F.col("s_correct").isNotNull()
        & (normalize_answer(F.col("s_answer")) == normalize_answer(F.col("answer_key")))
        & (F.col("s_correct") == F.col("right"))
        & (F.coalesce(F.col("s_reason"), F.lit("")) != "")
    )
    default = F.when(F.col("right"), F.lit(REASON_RIGHT)).otherwise(F.lit(REASON_WRONG))
    zero = money(F.lit(0))
    awarded = (
        F.when(F.col("objective"), F.when(F.col("right"), F.col("max_score")).otherwise(zero))
        .when(F.col("scored"), money(F.coalesce(F.col("s_score"), F.lit(0.0))))
        .otherwise(zero)
    )
    return rows.select(
        *ITEM,
        "number",
        F.when(F.col("objective"), F.col("right")).when(F.col("scored"), F.col("s_correct")).alias("is_correct"),
        F.least(F.col("max_score"), F.greatest(zero, awarded)).alias("score_awarded"),
        "max_score",
        F.when(F.col("answered") | F.col("objective") | F.col("scored"), F.lit("graded"))
        .otherwise(F.lit("unanswered"))
        .alias("grading_status"),
        F.when(F.col("objective"), F.col("answer_key"))
        .when(F.col("scored"), F.col("s_answer"))
        .when(~F.col("answered"), F.lit(""))
        .otherwise(F.coalesce(F.col("answer_key"), F.lit("")))
        .alias("correct_answer"),
        F.when(F.col("objective"), F.when(agrees, F.col("s_reason")).otherwise(default))
        .when(F.col("scored"), F.col("s_reason"))
        .when(~F.col("answered"), F.lit(REASON_UNANSWERED))
        .otherwise(F.lit(REASON_MANUAL))
        .alias("reason"),
    )


def grade_summary(results: DataFrame) -> DataFrame:
    """Score (at most 100) and counts per record."""
    unanswered = F.col("grading_status") == "unanswered"
    return results.groupBy(*RECORD).agg(
        F.least(F.lit(100).cast("decimal(22,2)"), F.sum("score_awarded")).cast("double").alias("total_score"),
        F.count("*").alias("question_count"),
        F.count_if(~unanswered).alias("graded_count"),
        F.count_if(unanswered).alias("unanswered_count"),
        F.count_if(F.col("is_correct")).alias("correct_count"),
    )


def review_focus(results: DataFrame, wrong: int = 3, undecided: int = 2) -> DataFrame:
    """Numbers to look at first: the first wrong ones, then the first undecided ones."""
    classed = results.filter(F.col("grading_status") != "unanswered").withColumn(
        "rank_class",
        F.when(F.col("is_correct").isNull(), F.lit(2)).when(~F.col("is_correct"), F.lit(1)),
    ).filter(F.col("rank_class").isNotNull())
    order = Window.partitionBy(*RECORD, "rank_class").orderBy("number", "question_id")
    # The plain bound lets Spark drop rows map-side before the window's shuffle.
    kept = classed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(wrong, undecided))
    kept = kept.filter(F.col("place") <= F.when(F.col("rank_class") == 1, wrong).otherwise(undecided))
    listed = F.array_sort(F.collect_list(F.struct("rank_class", "place", F.col("number").cast("string").alias("n"))))
    return kept.groupBy(*RECORD).agg(
        F.array_join(F.transform(listed, lambda s: s["n"]), "、").alias("focus")
    )


def result_state(results: DataFrame) -> DataFrame:
    """Card state of each result, and the state of its navigation button."""
    unanswered = F.col("grading_status") == "unanswered"
    score = F.coalesce(F.col("score_awarded"), F.lit(0))
    state = (
        F.when(unanswered, "unanswered")
        .when(F.col("is_correct").isNull(), "pending")
        .when(F.col("is_correct"), "correct")
        .when(score > 0, "partial")
        .otherwise("wrong")
    )
    full = (F.col("max_score") > 0) & (score >= F.col("max_score"))
    button = (
        F.when(unanswered | F.col("is_correct").isNull(), "unanswered")
        .when(F.col("is_correct") | full, "correct")
        .when(score > 0, "partial")
        .otherwise("wrong")
    )
    return results.select(*ITEM, state.alias("state"), button.alias("button_state"))


def attempt_progress(answers: DataFrame, marks: DataFrame, paper_counts: DataFrame) -> DataFrame:
    """Answered, total and doubtful questions per record.

    ``answers``: item keys and ``student_answer``; ``marks``: item keys of doubtful questions;
    ``paper_counts``: ``paper_id, question_count``.
    """
    answered = answers.select(
        *RECORD, has_answer(F.col("student_answer")).cast("int").alias("answered"), F.lit(0).alias("doubtful")
    )
    doubtful = marks.select(*ITEM).distinct().select(*RECORD, F.lit(0).alias("answered"), F.lit(1).alias("doubtful"))
    return (
        answered.unionByName(doubtful)
        .groupBy(*RECORD)
        .agg(F.sum("answered").alias("answered"), F.sum("doubtful").alias("doubtful"))
        .join(paper_counts.select("paper_id", F.col("question_count").alias("total")), "paper_id", "left")
        .select(*RECORD, "answered", "total", "doubtful")
    )


def gradable_gate(attempts: DataFrame, quality: DataFrame) -> DataFrame:
    """Accept or refuse each record with a reason; ``quality``: ``paper_id, status, is_collection``."""
    reason = F.when(F.col("status") == "incomplete", F.lit("incomplete_paper")).when(
        F.col("is_collection"), F.lit("collection")
    )
    return (
        attempts.select(*RECORD)
        .join(quality, "paper_id", "left")
        .select(*RECORD, reason.isNull().alias("accepted"), reason.alias("reject_reason"))
    )
