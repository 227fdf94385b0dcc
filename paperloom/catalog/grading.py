"""G*: grading."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import grading as gr
from .registry import query


def items(r) -> DataFrame:
    return r.v_answers.select(
        "attempt_id", "paper_id", "question_id", "number", "section_no", "type", "answer_key", "supp",
        F.coalesce("answer_by_id", "answer_by_number").alias("student_answer"),
        F.col("type").isin("single_choice").alias("has_options"),
        F.concat(F.lit("section-"), F.col("section_no").cast("string")).alias("context_key"),
    )


def scored_items(r) -> DataFrame:
    return gr.item_scores(items(r), r.v_sections)


def results(r) -> DataFrame:
    return gr.merge_results(scored_items(r), r.v_scored)


def _norm(x: str) -> str:
    t = f"upper(trim(coalesce({x}, '')))"
    return (
        f"CASE WHEN regexp_full_match({t}, '[A-Z]{{2,}}') THEN array_to_string(list_sort(string_split({t}, '')), '|')"
        f" ELSE array_to_string(list_sort(list_filter(string_split_regex({t}, '[,;\\s]+'), lambda p: p <> '')), '|') END"
    )


_ITEMS = f"""i AS (SELECT a.*, coalesce(answer_by_id, answer_by_number) AS sa, trim(coalesce(answer_by_id, answer_by_number, '')) <> '' AS answered,
 answer_key IS NOT NULL AND type = 'single_choice' AS keyed, type = 'single_choice' AS opt,
 {_norm('coalesce(answer_by_id, answer_by_number)')} AS sub, {_norm('answer_key')} AS exp,
 CASE WHEN s.score > 0 THEN CAST(s.score AS DOUBLE) ELSE (2 * s.total_score * 100 + s.n_questions) // (2 * s.n_questions) / 100.0 END AS max_score
 FROM v_answers a JOIN v_sections s USING (paper_id, section_no))"""
_RES = f"""{_ITEMS}, r AS (SELECT i.attempt_id, i.paper_id, i.question_id, i.number, i.max_score, answered, answered AND keyed AS obj, exp <> '' AND exp = sub AS rgt,
 s.attempt_id IS NOT NULL AND answered AND (NOT (answered AND keyed) OR opt) AS sc, s.is_correct AS sv, s.score_awarded AS sp, s.correct_answer AS sk, s.reason AS sr, i.answer_key,
 {_norm('s.correct_answer')} = exp AS samekey
 FROM i LEFT JOIN v_scored s USING (attempt_id, paper_id, question_id)),
res AS (SELECT attempt_id, paper_id, question_id, number, CASE WHEN obj THEN rgt WHEN sc THEN sv END AS is_correct,
 least(max_score, greatest(0.0, CASE WHEN obj THEN CASE WHEN rgt THEN max_score ELSE 0 END WHEN sc THEN sp ELSE 0 END)) AS score_awarded, max_score,
 CASE WHEN answered THEN 'graded' ELSE 'unanswered' END AS grading_status,
 CASE WHEN obj THEN answer_key WHEN sc THEN sk WHEN NOT answered THEN '' ELSE coalesce(answer_key, '') END AS correct_answer,
 CASE WHEN obj THEN CASE WHEN sc AND sv IS NOT NULL AND samekey AND sv = rgt THEN sr WHEN rgt THEN '答案正确。' ELSE '答案与标准答案不一致。' END
  WHEN sc THEN sr WHEN NOT answered THEN '未作答，未调用 AI 判卷。' ELSE '未能完成 AI 判卷，请人工复核。' END AS reason FROM r)"""


@query("G1", "SELECT attempt_id, paper_id, question_id, coalesce(answer_by_id, answer_by_number) AS student_answer FROM v_answers")
def _lookup(r):
    a = r.v_answers
    stored = a.filter(F.col("answer_by_id").isNotNull()).select(
        "attempt_id", "paper_id", F.col("question_id").alias("answer_name"), F.col("answer_by_id").alias("answer")
    ).union(
        a.filter(F.col("answer_by_number").isNotNull()).select(
            "attempt_id", "paper_id", F.col("number").cast("string"), "answer_by_number"
        )
    )
    return gr.answer_lookup(a.select("attempt_id", "paper_id", "question_id", "number"), stored)


@query("G2", f"WITH {_ITEMS} SELECT attempt_id, paper_id, question_id, sub AS submitted, exp AS expected FROM i")
def _normalize(r):
    return gr.normalize_answers(items(r))


@query("G3", f"WITH {_ITEMS} SELECT attempt_id, paper_id, question_id, answered FROM i")
def _answered(r):
    return gr.answered_flags(items(r))


@query("G4", f"WITH {_ITEMS} SELECT attempt_id, paper_id, question_id, keyed AS objective, NOT keyed OR opt AS to_scorer FROM i WHERE answered")
def _route(r):
    return gr.route_items(items(r)).select("attempt_id", "paper_id", "question_id", "objective", "to_scorer")


@query("G5", f"""WITH {_ITEMS} SELECT attempt_id, paper_id, question_id, exp <> '' AND exp = sub AS is_correct, CASE WHEN exp <> '' AND exp = sub THEN max_score ELSE 0.0 END AS score_awarded
FROM i WHERE answered AND keyed""")
def _objective(r):
    return gr.grade_objective(scored_items(r))


@query("G6", f"""WITH {_ITEMS}, b AS (SELECT *, (row_number() OVER (PARTITION BY attempt_id, paper_id ORDER BY number) - 1) // 12 AS batch FROM i WHERE answered AND (NOT keyed OR opt))
SELECT attempt_id, paper_id, batch, count(*) AS items, string_agg(DISTINCT 'section-' || section_no, ',' ORDER BY 'section-' || section_no) AS materials FROM b GROUP BY ALL""")
def _batches(r):
    return gr.scorer_batches(items(r))


_RAW = """raw AS (SELECT attempt_id, paper_id, question_id, 1 AS seq, is_correct, score_awarded FROM v_scored
UNION ALL SELECT attempt_id, paper_id, question_id, 2, NOT is_correct, score_awarded + 1 FROM v_scored WHERE question_key % 3 = 0
UNION ALL SELECT attempt_id, paper_id, question_id || 'x', 1, is_correct, score_awarded FROM v_scored WHERE question_key % 5 = 0)"""


@query("G7", f"""WITH {_ITEMS}, {_RAW} SELECT raw.attempt_id, raw.paper_id, raw.question_id, arg_max(ROW(raw.is_correct), seq)[1] AS is_correct, arg_max(score_awarded, seq) AS score_awarded
FROM raw JOIN i USING (attempt_id, paper_id, question_id) WHERE answered AND (NOT keyed OR opt) GROUP BY ALL""")
def _accept(r):
    keys = ["attempt_id", "paper_id", "question_id"]
    s = r.v_scored
    raw = (
        s.select(*keys, F.lit(1).alias("seq"), "is_correct", "score_awarded")
        .union(s.filter("question_key % 3 = 0").select(*keys, F.lit(2), ~F.col("is_correct"), F.col("score_awarded") + 1))
        .union(
            s.filter("question_key % 5 = 0").select(
                "attempt_id", "paper_id", F.concat("question_id", F.lit("x")), F.lit(1), "is_correct", "score_awarded"
            )
        )
    )
    return gr.accept_scorer_results(raw, items(r))


@query("G8", f"WITH {_RES} SELECT * FROM res")
def _merge(r):
    return results(r).withColumn("score_awarded", F.col("score_awarded").cast("double")).withColumn(
        "max_score", F.col("max_score").cast("double")
    )


@query("G9", f"""WITH {_RES} SELECT attempt_id, paper_id, least(100.0, CAST(sum(CAST(score_awarded AS DECIMAL(12,2))) AS DOUBLE)) AS total_score, count(*) AS question_count,
 count(*) FILTER (grading_status <> 'unanswered') AS graded_count, count(*) FILTER (grading_status = 'unanswered') AS unanswered_count, count(*) FILTER (is_correct) AS correct_count
FROM res GROUP BY ALL""")
def _summary(r):
    return gr.grade_summary(results(r))


@query("G10", f"""WITH {_RES}, c AS (SELECT *, CASE WHEN is_correct IS NULL THEN 2 WHEN NOT is_correct THEN 1 END AS k FROM res WHERE grading_status <> 'unanswered'),
n AS (SELECT *, row_number() OVER (PARTITION BY attempt_id, paper_id, k ORDER BY number) AS rn FROM c WHERE k IS NOT NULL)
SELECT attempt_id, paper_id, string_agg(CAST(number AS VARCHAR), '、' ORDER BY k, rn) AS focus FROM n WHERE rn <= CASE k WHEN 1 THEN 3 ELSE 2 END GROUP BY ALL""")
def _focus(r):
    return gr.review_focus(results(r))


@query("G11", f"""WITH {_RES} SELECT attempt_id, paper_id, question_id,
 CASE WHEN grading_status = 'unanswered' THEN 'unanswered' WHEN is_correct IS NULL THEN 'pending' WHEN is_correct THEN 'correct' WHEN score_awarded > 0 THEN 'partial' ELSE 'wrong' END AS state,
 CASE WHEN grading_status = 'unanswered' OR is_correct IS NULL THEN 'unanswered' WHEN is_correct OR (max_score > 0 AND score_awarded >= max_score) THEN 'correct' WHEN score_awarded > 0 THEN 'partial' ELSE 'wrong' END AS button_state
FROM res""")
def _state(r):
    return gr.result_state(results(r))


@query("G12", f"""WITH {_ITEMS} SELECT i.attempt_id, i.paper_id, count(*) FILTER (answered) AS answered, p.question_count AS total, count(*) FILTER (supp % 6 = 0) AS doubtful
FROM i JOIN v_papers p USING (paper_id) GROUP BY ALL""")
def _progress(r):
    i = items(r)
    return gr.attempt_progress(i, i.filter("supp % 6 = 0"), r.v_papers)


@query("G13", """SELECT DISTINCT attempt_id, a.paper_id, NOT (status = 'incomplete' OR is_collection) AS accepted,
 CASE WHEN status = 'incomplete' THEN 'incomplete_paper' WHEN is_collection THEN 'collection' END AS reject_reason FROM v_answers a LEFT JOIN v_quality q USING (paper_id)""")
def _gate(r):
    return gr.gradable_gate(r.v_answers.select("attempt_id", "paper_id").distinct(), r.v_quality)
