"""L*: flattening and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Roles
from ..operators import flatten as fl
from .nested import papers
from .registry import query

_PLACED = """
SELECT CAST(paper_id AS VARCHAR) AS paper_id, section_no - 1 AS section_index, group_no - 1 AS group_index,
 row_number() OVER (PARTITION BY paper_id ORDER BY number) - 1 AS position, number AS n, v.*  EXCLUDE (paper_id, number)
FROM v_questions v
"""


@query("L1", """
SELECT DISTINCT CAST(paper_id AS VARCHAR) AS paper_id, section_no - 1 AS section_index, 'section-' || section_no AS section_id,
 section_title AS title, CAST(20.0 AS DOUBLE) AS total_score, CAST(1.5 AS DOUBLE) AS score FROM v_questions""")
def _sections(r: Roles):
    return fl.sections(papers(r))


@query("L2", """
SELECT CAST(paper_id AS VARCHAR) AS paper_id, section_no - 1 AS section_index, group_no - 1 AS group_index,
 'Passage ' || group_no AS title, count(*) AS n_questions
FROM v_questions WHERE group_no IS NOT NULL GROUP BY ALL""")
def _groups(r: Roles):
    return fl.groups(papers(r))


@query("L3", f"""
SELECT paper_id, section_index, group_index, position, CASE WHEN n % 13 = 0 THEN '' ELSE question_id END AS question_id,
 CASE WHEN n % 17 = 0 THEN '' ELSE CAST(n AS VARCHAR) END AS number, CASE WHEN n % 19 = 0 THEN '' ELSE type END AS type, ' ' || stem AS stem
FROM ({_PLACED})""")
def _questions(r: Roles):
    return fl.questions(papers(r))


@query("L4", f"""
SELECT paper_id, position, i AS option_index, substr('ABCD', i + 1, 1) AS option_id,
 trim(CASE i WHEN 0 THEN opt_a WHEN 1 THEN opt_b WHEN 2 THEN opt_c ELSE opt_d END) AS text
FROM ({_PLACED}), (SELECT unnest([0, 1, 2, 3]) AS i)""")
def _options(r: Roles):
    return fl.options(papers(r))


@query("L5", f"""
SELECT paper_id, position, 'A=' || opt_a || '|B=' || opt_b || '|C=' || trim(opt_c) || '|D=' || opt_d AS options FROM ({_PLACED})""")
def _normalized_options(r: Roles):
    return fl.normalize_options(papers(r))


@query("L6", f"""
SELECT paper_id, position, CASE WHEN n % 13 = 0 THEN 'q' || (position + 1) ELSE question_id END AS question_id,
 CASE WHEN n % 17 = 0 THEN CAST(position + 1 AS VARCHAR) ELSE CAST(n AS VARCHAR) END AS number,
 CASE WHEN n % 19 = 0 THEN 'unknown' ELSE type END AS type, trim(stem) AS stem, CAST(n % 7 AS VARCHAR) AS source_pages
FROM ({_PLACED})""")
def _normalized_questions(r: Roles):
    return fl.normalize_questions(papers(r))


@query("L7", """
SELECT paper_id, section_no, CASE section_no WHEN 1 THEN 'choice' WHEN 2 THEN 'cloze' WHEN 3 THEN 'reading' WHEN 4 THEN 'translation' ELSE 'writing' END AS kind
FROM v_sections""")
def _kind(r: Roles):
    return fl.section_labels(r.v_sections).select("paper_id", "section_no", "kind")


@query("L8", """
SELECT paper_id, section_no, 'part-' || upper(regexp_extract(section_title, 'Part ([IVX]+)', 1)) AS section_key FROM v_sections""")
def _key(r: Roles):
    return fl.section_labels(r.v_sections).select("paper_id", "section_no", "section_key")


@query("L9", """
SELECT paper_id, section_no, trim(regexp_replace(lower(section_title), '\\([^()]*(minutes?|points?)[^()]*\\)', '', 'g')) AS canonical_key FROM v_sections""")
def _canonical(r: Roles):
    return fl.section_labels(r.v_sections).select("paper_id", "section_no", "canonical_key")


@query("L10", """
SELECT paper_id, section_no, CASE regexp_extract(section_title, 'Part ([IVX]+)', 1) WHEN 'I' THEN '1' WHEN 'II' THEN '2' WHEN 'III' THEN '3' WHEN 'IV' THEN '4' WHEN 'V' THEN '5' END AS part_number
FROM v_sections""")
def _part(r: Roles):
    return fl.section_labels(r.v_sections).select("paper_id", "section_no", "part_number")


@query("L11", f"""
WITH p AS ({_PLACED}), k AS (SELECT *, CASE WHEN n % 13 = 0 THEN CASE WHEN n % 17 = 0 THEN '' ELSE CAST(n AS VARCHAR) END ELSE question_id END AS qid FROM p)
SELECT paper_id, qid AS question_id, section_title,
 'directions ' || section_no || CASE WHEN group_no IS NULL THEN '' ELSE chr(10) || chr(10) || 'text of passage ' || group_no END AS context_text,
 paper_id || ':section-' || section_index || CASE WHEN group_no IS NULL THEN '' ELSE ':group-' || group_index END AS context_key,
 'section-' || section_no || CASE WHEN group_no IS NULL THEN '' ELSE '-group-' || group_no END AS grading_key,
 string_agg(qid, ',' ORDER BY n) OVER (PARTITION BY paper_id, section_no, group_no ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sibling_ids
FROM k WHERE qid <> ''""".replace("string_agg(qid, ',' ORDER BY n) OVER", "string_agg(qid, ',') OVER"))
def _contexts(r: Roles):
    return fl.question_contexts(papers(r))


@query("L12", """
WITH k AS (SELECT paper_id, section_no, n_questions, CASE section_no WHEN 1 THEN 'choice' WHEN 2 THEN 'cloze' WHEN 3 THEN 'reading' WHEN 4 THEN 'translation' ELSE 'writing' END AS kind FROM v_sections),
t AS (SELECT paper_id, count(*) FILTER (n_questions = 20 AND section_no <= 2) = 2 AND count(*) = 5 AND sum(n_questions) = 54 AS full FROM k GROUP BY paper_id),
m AS (SELECT k.*, p.exam_format IS NOT NULL OR t.full AS standard, p.exam_format FROM k JOIN t USING (paper_id) JOIN v_papers p USING (paper_id)),
s AS (SELECT *, CASE WHEN NOT standard THEN section_no WHEN exam_format = 'cet4' THEN list_position(['writing','listening','wordbank','matching','reading','translation','other'], kind)
 ELSE list_position(['choice','listening','cloze','wordbank','translation','matching','reading','writing','other'], kind) END AS slot FROM m)
SELECT paper_id, standard, row_number() OVER (PARTITION BY paper_id ORDER BY slot) AS page_no, kind, n_questions FROM s WHERE slot > 0""")
def _layout(r: Roles):
    return fl.exam_layout(r.v_papers, r.v_sections)


_COUNTS = """SELECT paper_id, CAST(sum(n_questions) AS BIGINT) AS question_count, string_agg(CAST(section_no AS VARCHAR), ',' ORDER BY section_no) AS part_numbers,
 bool_or(total_score <= 0 OR score <= 0) AS weak FROM v_sections GROUP BY paper_id"""


@query("L13", _COUNTS)
def _counts(r: Roles):
    return fl.paper_counts(r.v_sections)


@query("L14", f"""
WITH s AS ({_COUNTS}), c AS (SELECT paper_id, count(*) AS question_count, count(DISTINCT section_no) AS parts FROM v_kept_questions GROUP BY paper_id)
SELECT s.paper_id, CASE WHEN p.exam_format = 'cet4' THEN TRUE WHEN s.question_count < 50 OR s.part_numbers <> '1,2,3,4,5' THEN FALSE
 ELSE s.question_count <> c.question_count OR c.parts < 5 OR s.weak END AS use_standard
FROM s JOIN c USING (paper_id) JOIN v_papers p USING (paper_id)""")
def _better(r: Roles):
    found = r.v_kept_questions.groupBy("paper_id", "section_no").agg(F.count("*").alias("n_questions"))
    current = r.v_sections.drop("n_questions").join(found, ["paper_id", "section_no"])
    standard = fl.paper_counts(r.v_sections).join(r.v_papers.select("paper_id", "exam_format"), "paper_id")
    return fl.select_better_paper(standard, fl.paper_counts(current))
