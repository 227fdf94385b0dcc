"""Nested paper documents built from the flat question role.

A paper here holds at most 54 questions by construction (the paper id is the question
key divided by 54), so collecting a paper into one row is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..fixtures import Roles


def papers(roles: Roles) -> DataFrame:
    n = F.col("number")
    option = lambda name, letter: F.struct(
        F.when(n % 5 != 0, F.lit(letter)).otherwise(F.lit("")).alias("id"), F.col(name).alias("text")
    )
    q = F.struct(
        F.when(n % 13 == 0, F.lit("")).otherwise(F.col("question_id")).alias("id"),
        F.when(n % 17 == 0, F.lit("")).otherwise(n.cast("string")).alias("number"),
        F.when(n % 19 == 0, F.lit("")).otherwise(F.col("type")).alias("type"),
        F.concat(F.lit(" "), F.col("stem")).alias("stem"),
        F.array(option("opt_a", "A"), option("opt_b", "B"), option("opt_c", "C"), option("opt_d", "D")).alias("options"),
        F.when(F.col("answer_key").isNotNull(), F.array("answer_key")).alias("answer"),
        F.lit("").alias("analysis"),
        F.array((n % 7).cast("string"), F.lit("x")).alias("source_pages"),
        F.lit(None).cast("double").alias("score"),
    )
    rows = roles.v_questions.select("paper_id", "section_no", "section_title", "group_no", "number", q.alias("q"))
    ordered = lambda cond=None: F.transform(
        F.array_sort(F.collect_list(F.struct("number", "q"))), lambda s: s["q"]
    )
    by_group = (
        rows.repartition("paper_id")
        .groupBy("paper_id", "section_no", "section_title", "group_no")
        .agg(ordered().alias("qs"))
    )
    group = F.when(
        F.col("group_no").isNotNull(),
        F.struct(
            "group_no",
            F.struct(
                F.concat(F.lit("g"), F.col("group_no").cast("string")).alias("id"),
                F.concat(F.lit("Passage "), F.col("group_no").cast("string")).alias("title"),
                F.concat(F.lit("text of passage "), F.col("group_no").cast("string")).alias("description"),
                F.col("qs").alias("questions"),
            ).alias("g"),
        ),
    )
    by_section = by_group.groupBy("paper_id", "section_no", "section_title").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("group_no", "qs"))), lambda s: s["qs"])).alias("qs"),
        F.transform(F.array_sort(F.collect_list(group)), lambda s: s["g"]).alias("groups"),
    )
    section = F.struct(
        F.concat(F.lit("section-"), F.col("section_no").cast("string")).alias("id"),
        F.lit("").alias("type"),
        F.col("section_title").alias("title"),
        F.concat(F.lit(" directions "), F.col("section_no").cast("string"), F.lit(" ")).alias("description"),
        F.lit(20.0).alias("total_score"),
        F.lit(1.5).alias("score"),
        F.col("qs").alias("questions"),
        F.col("groups"),
    )
    return (
        by_section.groupBy("paper_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("section_no", section.alias("s")))), lambda x: x["s"]).alias("sections"))
        .select(F.col("paper_id").cast("string").alias("id"), "sections")
    )
