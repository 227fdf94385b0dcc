"""D*: section scores. The SQL works in whole cents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import part_number
from ..operators import pages, scoring as sc
from .registry import query


def _doubles(df: DataFrame) -> DataFrame:
    return df.withColumn("total_score", F.col("total_score").cast("double")).withColumn(
        "score", F.col("score").cast("double")
    )


_CENTS = "SELECT paper_id, section_no, n_questions AS n, CAST(total_score * 100 AS BIGINT) AS t, CAST(score * 100 AS BIGINT) AS s FROM v_sections"

# Rounded quotient of two positive whole numbers.
def _div(a: str, b: str) -> str:
    return f"((2 * ({a}) + ({b})) // (2 * ({b})))"


_FILLED = f"""f AS (SELECT paper_id, section_no, n, CASE WHEN t <= 0 AND s > 0 THEN s * n ELSE t END AS t,
 CASE WHEN s <= 0 AND t > 0 THEN {_div('t', 'n')} ELSE s END AS s FROM ({_CENTS}))"""
_SCALED = f"""{_FILLED}, g AS (SELECT *, sum(t) OVER (PARTITION BY paper_id) AS pt, sum(n) OVER (PARTITION BY paper_id) AS pn FROM f),
h AS (SELECT *, CASE WHEN pt > 0 THEN {_div('t * 10000', 'pt')} ELSE {_div('10000', 'pn')} * n END AS t2 FROM g),
k AS (SELECT paper_id, section_no, n, t2, CASE WHEN pt > 0 THEN {_div('t2', 'n')} ELSE {_div('10000', 'pn')} END AS s2 FROM h)"""


@query("D1", f"""
WITH c AS ({_CENTS}), m AS (SELECT paper_id, section_no, sum(qs) AS qs, count(*) AS c FROM (
  SELECT paper_id, section_no, CASE WHEN question_key % 3 = 0 THEN 0 ELSE question_key % 4 * 50 END AS qs FROM v_questions) WHERE qs > 0 GROUP BY ALL),
d AS (SELECT c.paper_id, c.section_no, n, t, CASE WHEN s > 0 THEN s WHEN m.c IS NOT NULL THEN {_div('m.qs', 'm.c')} ELSE 0 END AS s FROM c LEFT JOIN m USING (paper_id, section_no))
SELECT paper_id, section_no, n AS n_questions, (CASE WHEN t <= 0 AND s > 0 THEN s * n ELSE t END) / 100.0 AS total_score,
 (CASE WHEN s <= 0 AND t > 0 THEN {_div('t', 'n')} ELSE s END) / 100.0 AS score FROM d""")
def _fill(r):
    per_question = r.v_questions.select(
        "paper_id", "section_no",
        F.when(F.col("question_key") % 3 == 0, 0).otherwise(F.col("question_key") % 4 * F.lit(0.5)).alias("question_score"),
    )
    return _doubles(sc.fill_section_scores(r.v_sections, per_question))


@query("D2", f"WITH {_SCALED} SELECT paper_id, section_no, n AS n_questions, t2 / 100.0 AS total_score, s2 / 100.0 AS score FROM k")
def _scale(r):
    return _doubles(sc.scale_to_100(sc.fill_section_scores(r.v_sections)))


@query("D3", f"""WITH {_SCALED}, l AS (SELECT *, 10000 - sum(t2) OVER (PARTITION BY paper_id) AS rest, max(section_no) OVER (PARTITION BY paper_id) AS last FROM k)
SELECT paper_id, section_no, n AS n_questions, (CASE WHEN section_no = last THEN t2 + rest ELSE t2 END) / 100.0 AS total_score,
 (CASE WHEN section_no = last AND rest <> 0 THEN {_div('t2 + rest', 'n')} ELSE s2 END) / 100.0 AS score FROM l""")
def _residual(r):
    return _doubles(sc.normalize_scores(r.v_sections))


@query("D4", f"""SELECT paper_id, section_no, n AS n_questions, (CASE WHEN section_no = 1 THEN 3000 ELSE t END) / 100.0 AS total_score,
 (CASE WHEN section_no = 1 THEN {_div('3000', 'n')} ELSE s END) / 100.0 AS score FROM ({_CENTS})""")
def _points(r):
    sections = r.v_sections.withColumn("part_number", part_number(F.col("section_title")))
    return _doubles(sc.apply_part_points(sections, pages.part_metadata(r.v_part_lines)))
