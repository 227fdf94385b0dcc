"""Section scores in exact decimals (halves round up).

Input rows: ``paper_id, section_no, n_questions, total_score, score``. Paper totals are
aggregated (partial sums before the shuffle) and joined back, so no task has to hold all
sections of a paper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.answers import money, ratio


def fill_section_scores(sections: DataFrame, question_scores: DataFrame | None = None) -> DataFrame:
    """Missing score: mean of the positive question scores, else total / n. Missing total: score × n.

    ``question_scores``: ``paper_id, section_no, question_score``.
    """
    rows = sections
    if question_scores is not None:
        positive = question_scores.filter(F.col("question_score") > 0)
        means = positive.groupBy("paper_id", "section_no").agg(
            F.sum(F.col("question_score").cast("decimal(12,2)")).alias("s"), F.count("*").alias("c")
        ).select("paper_id", "section_no", ratio(F.col("s"), F.col("c")).alias("mean_score"))
        rows = rows.join(means, ["paper_id", "section_no"], "left")
    else:
        rows = rows.withColumn("mean_score", F.lit(None).cast("decimal(12,2)"))
    n = F.col("n_questions")
    rows = rows.withColumn("total_score", money(F.col("total_score"))).withColumn(
        "score",
        F.when(F.col("score") > 0, money(F.col("score"))).otherwise(F.coalesce(F.col("mean_score"), money(F.lit(0)))),
    )
    total = F.when((F.col("total_score") <= 0) & (F.col("score") > 0), money(F.col("score") * n)).otherwise(F.col("total_score"))
    score = F.when((F.col("score") <= 0) & (F.col("total_score") > 0), ratio(F.col("total_score"), n)).otherwise(F.col("score"))
    return rows.select(
        "paper_id", "section_no", n, total.alias("total_score"), score.alias("score")
    )


def scale_to_100(filled: DataFrame) -> DataFrame:
    """Scale section totals so that a paper is worth 100; an all-zero paper is split evenly."""
    rows = filled.filter(F.col("n_questions") > 0)
    positive = F.greatest(F.col("total_score"), F.lit(0).cast("decimal(12,2)"))
    paper = rows.groupBy("paper_id").agg(
        F.sum(positive).alias("paper_total"), F.sum("n_questions").alias("paper_questions")
    )
    n = F.col("n_questions")
    even = ratio(F.lit(100), F.col("paper_questions"))
    worth = F.col("paper_total") > 0
    total = F.when(worth, ratio(positive * 100, F.col("paper_total"))).otherwise(money(even * n))
    return (
        rows.join(paper, "paper_id")
        .withColumn("total_score", total)
        .select(
            "paper_id", "section_no", "n_questions", "total_score",
            F.when(worth, ratio(F.col("total_score"), n)).otherwise(even).alias("score"),
        )
    )


def residual_to_last(scaled: DataFrame) -> DataFrame:
    """The rounding remainder goes to the last section, so that totals are exactly 100."""
    paper = scaled.groupBy("paper_id").agg(
        F.sum("total_score").alias("paper_total"), F.max("section_no").alias("last_section")
    )
    rest = money(F.lit(100) - F.col("paper_total"))
    moved = (F.col("section_no") == F.col("last_section")) & (rest != 0)
    total = F.when(moved, money(F.col("total_score") + rest)).otherwise(F.col("total_score"))
    return (
        scaled.join(paper, "paper_id")
        .withColumn("new_total", total)
        .select(
            "paper_id", "section_no", "n_questions", F.col("new_total").alias("total_score"),
            F.when(moved, ratio(F.col("new_total"), F.col("n_questions"))).otherwise(F.col("score")).alias("score"),
        )
    )


def normalize_scores(sections: DataFrame, question_scores: DataFrame | None = None) -> DataFrame:
    return residual_to_last(scale_to_100(fill_section_scores(sections, question_scores)))


def apply_part_points(sections: DataFrame, part_points: DataFrame) -> DataFrame:
    """Printed part points spread over all questions of the part; remainder to its last section.

    ``sections`` also carries ``part_number``; ``part_points``: ``paper_id, part_number, points``.
    """
    keys = ["paper_id", "part_number"]
    parts = (
        sections.groupBy(*keys)
        .agg(F.sum("n_questions").alias("part_questions"), F.max("section_no").alias("last_section"))
        .join(part_points.filter(F.col("points") > 0), keys)
        .filter(F.col("part_questions") > 0)
        .withColumn("part_score", ratio(F.col("points"), F.col("part_questions")))
        .withColumn("rest", money(F.col("points") - F.col("part_score") * F.col("part_questions")))
        .select(*keys, "part_score", "last_section", "rest")
    )
    scored = F.col("part_score").isNotNull() & (F.col("n_questions") > 0)
    total = F.when(scored, money(F.col("part_score") * F.col("n_questions"))).otherwise(money(F.col("total_score")))
    extra = F.when(F.col("section_no") == F.col("last_section"), F.col("rest")).otherwise(money(F.lit(0)))
    return sections.join(parts, keys, "left").select(
        "paper_id", "section_no", "n_questions",
        money(total + F.coalesce(extra, money(F.lit(0)))).alias("total_score"),
        F.when(scored, F.col("part_score")).otherwise(money(F.col("score"))).alias("score"),
    )
