"""Q*: structural checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import merge as mg, pages as pg, quality as ql
from .registry import query


def checked(r) -> DataFrame:
    letters = F.filter(F.split("option_ids", ""), lambda x: x != "")
    text = lambda o, i: F.when(i == 2, F.col("opt_c")).otherwise(F.lit("text"))
    options = F.transform(letters, lambda o, i: F.struct(o.alias("id"), text(o, i).alias("text")))
    return r.v_checked_questions.withColumn("options", options)


def source(r) -> ql.Source:
    return ql.Source(r.v_source_lines, checked(r))


def _row(code: str, severity: str, section="''", number="NULL", page="NULL", paper="paper_id") -> str:
    level = severity if severity.startswith("CASE") else f"'{severity}'"
    return f"{paper} AS paper_id, '{code}' AS code, {level} AS severity, {section} AS section, CAST({number} AS VARCHAR) AS number, CAST({page} AS BIGINT) AS page"


_Q = dict(section="section_title", number="number", page="page")
_Q1 = f"SELECT {_row('pdf_requires_vision', 'error', page='page', paper='doc_id')} FROM v_ocr_pages WHERE extraction_method = 'pdf_text'"
_Q2 = f"SELECT {_row('empty_section', 'warning', section='section_title')} FROM v_sections s WHERE NOT EXISTS (SELECT 1 FROM v_kept_questions k WHERE k.paper_id = s.paper_id AND k.section_no = s.section_no)"
_Q3 = f"SELECT DISTINCT {_row('duplicate_id', 'error', **_Q)} FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, question_id ORDER BY position) AS rn FROM v_checked_questions) WHERE question_id = '' OR rn > 1"
_Q4 = f"""SELECT DISTINCT {_row('duplicate_number', "CASE WHEN replace(stem, ' ', '') = p THEN 'error' ELSE 'warning' END", **_Q)} FROM (SELECT *, lag(replace(stem, ' ', '')) OVER (PARTITION BY paper_id, section_no, number ORDER BY position) AS p FROM v_checked_questions) WHERE p IS NOT NULL"""
_Q5 = f"SELECT {_row('missing_options', 'error', **_Q)} FROM v_checked_questions WHERE type = 'single_choice' AND length(option_ids) < 2"
_Q6 = f"SELECT {_row('invalid_options', 'error', **_Q)} FROM v_checked_questions WHERE option_ids = 'AAB' OR (length(option_ids) > 2 AND trim(opt_c) = '')"
_Q7 = f"SELECT {_row('missing_stem', 'error', **_Q)} FROM v_checked_questions WHERE section_no <> 2 AND trim(stem) = ''"
_Q8 = f"SELECT {_row('placeholder_stem', 'error', **_Q)} FROM v_checked_questions WHERE section_no <> 2 AND stem LIKE 'Question %'"


@query("Q0", f"SELECT DISTINCT * FROM (SELECT * FROM ({_Q3}) UNION ALL SELECT * FROM ({_Q4}) UNION ALL SELECT * FROM ({_Q5}) UNION ALL SELECT * FROM ({_Q6}) UNION ALL SELECT * FROM ({_Q7}) UNION ALL SELECT * FROM ({_Q8}) UNION ALL SELECT * FROM ({_Q8}))")
def _all(r):
    q = checked(r)
    return ql.combine([ql.question_issues(q), ql.placeholder_stem(q)])


@query("Q1", _Q1)
def _vision(r):
    return ql.pdf_requires_vision(r.v_ocr_pages.withColumnRenamed("doc_id", "paper_id"))


@query("Q2", _Q2)
def _empty(r):
    return ql.empty_section(r.v_sections, r.v_kept_questions)


@query("Q3", _Q3)
def _ids(r):
    return ql.duplicate_id(checked(r))


@query("Q4", _Q4)
def _numbers(r):
    return ql.duplicate_number(checked(r)).distinct()


@query("Q5", _Q5)
def _no_options(r):
    return ql.missing_options(checked(r))


@query("Q6", _Q6)
def _bad_options(r):
    return ql.invalid_options(checked(r))


@query("Q7", _Q7)
def _no_stem(r):
    return ql.missing_stem(checked(r))


@query("Q8", _Q8)
def _placeholder(r):
    return ql.placeholder_stem(checked(r))


@query("Q9", f"""WITH b AS (SELECT *, trim(regexp_replace(description, '(?is)^directions?\\s*:.*?(\\n\\s*\\n|$)', ''), ' ' || chr(10)) AS body FROM v_passages WHERE section_no IN (2, 3))
SELECT DISTINCT {_row('missing_passage', 'warning', section='b.section_title', page='q.page', paper='b.paper_id')} FROM b LEFT JOIN v_checked_questions q ON q.paper_id = b.paper_id AND q.section_no = b.section_no AND q.group_no IS NOT DISTINCT FROM b.group_no WHERE length(body) < 60""")
def _passage(r):
    return ql.missing_passage(r.v_passages, checked(r)).distinct()


_TYPE = "CASE paper_id % 3 WHEN 0 THEN 'listening' WHEN 1 THEN '' END"


@query("Q7_types", f"SELECT * FROM ({_Q7}) WHERE paper_id % 3 <> 0")
def _no_stem_by_type(r):
    return ql.missing_stem(checked(r).withColumn("section_type", F.expr(_TYPE)))


@query("Q8_types", f"SELECT * FROM ({_Q8}) WHERE paper_id % 3 <> 0")
def _placeholder_by_type(r):
    return ql.placeholder_stem(checked(r).withColumn("section_type", F.expr(_TYPE)))


@query("Q9_types", f"""WITH b AS (SELECT *, trim(regexp_replace(description, '(?is)^directions?\\s*:.*?(\\n\\s*\\n|$)', ''), ' ' || chr(10)) AS body FROM v_passages WHERE section_no IN (2, 3) AND paper_id % 3 <> 0 AND (description <> '' OR paper_id % 2 = 1))
SELECT DISTINCT {_row('missing_passage', 'warning', section='b.section_title', page='q.page', paper='b.paper_id')} FROM b LEFT JOIN v_checked_questions q ON q.paper_id = b.paper_id AND q.section_no = b.section_no AND q.group_no IS NOT DISTINCT FROM b.group_no WHERE length(body) < 60""")
def _passage_by_type(r):
    whole = F.expr("CASE WHEN paper_id % 2 = 0 THEN repeat('x', 80) ELSE '' END")
    return ql.missing_passage(r.v_passages.withColumn("section_type", F.expr(_TYPE)).withColumn("section_description", whole), checked(r)).distinct()


@query("Q10", f"SELECT {_row('section_score', 'warning', section='section_title')} FROM v_sections WHERE score <> 0 AND abs(CAST(score * 1000 AS BIGINT) * n_questions - total_score * 1000) > greatest(110, 11 * n_questions)")
def _section_score(r):
    return ql.section_score(r.v_sections)


@query("Q11", f"SELECT {_row('no_questions', 'error')} FROM v_library l WHERE NOT EXISTS (SELECT 1 FROM v_kept_questions k WHERE k.paper_id = l.paper_id)")
def _none(r):
    return ql.no_questions(r.v_library, r.v_kept_questions)


@query("Q12", f"SELECT {_row('total_score', 'error', paper='p.paper_id')} FROM v_papers p JOIN (SELECT paper_id, sum(total_score) AS t FROM v_sections GROUP BY paper_id) s USING (paper_id) WHERE abs(t - p.total_score) > 0.11")
def _total(r):
    return ql.total_score(r.v_papers, r.v_sections)


_SRC = """h AS (SELECT *, CASE WHEN line LIKE 'Part %' THEN CASE split_part(line, ' ', 2) WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'III' THEN 3 WHEN 'IV' THEN 4 ELSE 5 END END AS hd FROM v_source_lines),
l AS (SELECT *, last_value(hd IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY line_no) AS sec FROM h),
lab AS (SELECT *, 'part-' || CASE sec WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' ELSE 'V' END AS scope FROM l),
act AS (SELECT DISTINCT paper_id, section_no AS sec, number FROM v_checked_questions),
exp AS (SELECT DISTINCT paper_id, sec, scope, page, unnest(CASE WHEN line LIKE 'text %' THEN [regexp_extract(line, '__(\\d+)__', 1)] ELSE [regexp_extract(line, '^(\\d+)\\. +\\S', 1)] END) AS number FROM lab WHERE (line LIKE 'text %' OR regexp_matches(line, '^\\d+\\. +\\S')) AND line <> '1. first point'),
known AS (SELECT DISTINCT paper_id, sec FROM act),
mis AS (SELECT e.* FROM exp e JOIN known USING (paper_id, sec) WHERE NOT EXISTS (SELECT 1 FROM act a WHERE a.paper_id = e.paper_id AND a.sec = e.sec AND a.number = e.number)),
pg AS (SELECT DISTINCT paper_id, sec, scope, page FROM lab)"""


@query("Q13", f"""WITH {_SRC}, c AS (SELECT paper_id, sec, count(*) AS found FROM act GROUP BY ALL), d AS (SELECT paper_id, sec, 20 AS declared FROM lab WHERE line LIKE '%共%题')
SELECT {_row('declared_question_count', 'error', section='scope', page='page', paper='d.paper_id')} FROM d LEFT JOIN c USING (paper_id, sec) JOIN pg USING (paper_id, sec) WHERE coalesce(found, 0) <> declared""")
def _declared(r):
    return ql.declared_question_count(source(r))


@query("Q14", f"""WITH {_SRC} SELECT {_row('missing_writing_prompt', 'error', section='scope', page='page')} FROM pg WHERE sec = 5 AND paper_id % 2 = 1""")
def _prompt(r):
    sections = r.v_sections.select(
        "paper_id", "section_no", "section_title",
        F.when(F.col("paper_id") % 2 == 0, "on: My  School\nLIFE now").otherwise("").alias("description"),
    )
    return ql.missing_writing_prompt(source(r), sections)


@query("Q15", f"""WITH {_SRC} SELECT {_row('unmatched_source', 'warning', number='number', page='page')} FROM exp e WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.paper_id = e.paper_id AND k.sec = e.sec)""")
def _unmatched(r):
    return ql.unmatched_source(source(r))


@query("Q16", f"WITH {_SRC} SELECT {_row('missing_numbers', 'warning', section='scope', number='number', page='page')} FROM mis")
def _missing(r):
    return ql.missing_numbers(source(r))


@query("Q17", f"WITH {_SRC} SELECT {_row('missing_blanks', 'error', section='scope', number='number', page='page')} FROM mis WHERE sec = 2")
def _blanks(r):
    return ql.missing_blanks(source(r))


@query("Q18", f"""WITH s AS (SELECT DISTINCT paper_id, unnest(regexp_extract_all(lower(line), '[a-z]{{5,}}')) AS w FROM v_prose_lines WHERE line_no = 1 AND len(string_split_regex(trim(line), '\\s+')) > 12 AND NOT regexp_matches(line, '^\\s*(\\d+[.、]|[A-D][).])')),
m AS (SELECT DISTINCT paper_id, unnest(regexp_extract_all(lower(description), '[a-z]{{5,}}')) AS w FROM v_material),
c AS (SELECT s.paper_id, count(*) AS n, count(m.w) AS k FROM s LEFT JOIN m ON m.paper_id = s.paper_id AND m.w = s.w GROUP BY s.paper_id)
SELECT {_row('passage_coverage', 'warning', section="'part-III'", page='1')} FROM c WHERE n > 60 AND k / n < 0.55""")
def _coverage(r):
    return ql.passage_coverage(pg.scope_lines(r.v_prose_lines), r.v_material)


_OPT = f"""{_SRC}, blk AS (SELECT DISTINCT l.paper_id, q.section_no AS sec, l.scope, CAST(q.number AS VARCHAR) AS number FROM lab l JOIN v_questions q ON q.paper_id = l.paper_id AND q.number * 20 + 5 = l.line_no WHERE q.number <= 48 AND l.line LIKE 'A. %')"""


@query("Q19", f"""WITH {_OPT}, bad AS (SELECT DISTINCT b.* FROM blk b JOIN v_checked_questions c ON c.paper_id = b.paper_id AND c.section_no = b.sec AND c.number = b.number WHERE c.option_ids <> 'ABCD')
SELECT {_row('source_options', 'error', section='bad.scope', number='bad.number', page='e.page', paper='bad.paper_id')} FROM bad LEFT JOIN exp e USING (paper_id, sec, number)""")
def _source_options(r):
    return ql.source_options(source(r))


@query("Q20", f"""WITH {_OPT} SELECT {_row('confirmed_missing', 'error', section='m.scope', number='m.number', page='m.page', paper='m.paper_id')} FROM mis m JOIN blk b USING (paper_id, sec, number)""")
def _confirmed(r):
    return ql.confirmed_missing(source(r))


def warnings(r) -> DataFrame:
    windows = r.v_windows.select(
        "paper_id", "window_no", "error", F.array("page", F.col("page") + 1).alias("pages"),
        F.when(F.col("failed_page").isNotNull(), F.array("failed_page")).alias("failed_pages"),
    )
    return mg.extraction_warnings(windows)


WARNING_SQL = """SELECT paper_id, window_no, error, unnest(CASE WHEN failed_page IS NULL THEN [page, page + 1] ELSE [failed_page] END) AS page FROM v_windows WHERE error IS NOT NULL"""


@query("Q21", f"SELECT {_row('extraction_warning', 'error', page='page')} FROM ({WARNING_SQL})")
def _warnings(r):
    return ql.extraction_warning(warnings(r))


@query("Q22", f"SELECT {_row('no_source', 'warning')} FROM v_library l WHERE NOT EXISTS (SELECT 1 FROM v_ocr_pages p WHERE p.doc_id = l.paper_id)")
def _no_source(r):
    return ql.no_source(r.v_library, r.v_ocr_pages.withColumnRenamed("doc_id", "paper_id"))


@query("Q23", f"SELECT {_row('limited_pages', 'warning')} FROM v_library WHERE question_count > paper_id % 50")
def _limited(r):
    return ql.limited_pages(r.v_library.selectExpr("paper_id", "question_count AS source_page_count", "paper_id % 50 AS page_count"))


_Q24 = f"SELECT {_row('unconfirmed_format', 'warning')} FROM v_papers WHERE exam_format IS NULL"


@query("Q24", _Q24)
def _format(r):
    return ql.unconfirmed_format(r.v_papers)


@query("Q25", f"""WITH i AS (SELECT paper_id, severity FROM ({_Q6}) UNION ALL SELECT paper_id, severity FROM ({_Q24})),
q AS (SELECT paper_id, count(*) AS n FROM v_checked_questions GROUP BY paper_id), s AS (SELECT paper_id, bool_or(severity = 'error') AS e FROM i GROUP BY paper_id)
SELECT paper_id, CASE WHEN e THEN 'incomplete' WHEN e IS NOT NULL THEN 'review' ELSE 'ready' END AS status, coalesce(n, 0) AS question_count FROM v_papers LEFT JOIN s USING (paper_id) LEFT JOIN q USING (paper_id)""")
def _rollup(r):
    q = checked(r)
    return ql.rollup(r.v_papers, ql.combine([ql.invalid_options(q), ql.unconfirmed_format(r.v_papers)]), q)
