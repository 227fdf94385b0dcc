"""T*: page text to structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import safe_id  # noqa: F401
from ..operators import cet, merge as mg, pages as pg
from .registry import query

_LINES = "regexp_replace(text, '\\n$', '')"
_STRIPPED = f"""regexp_replace(array_to_string(list_transform(list_filter(string_split({_LINES}, chr(10)),
 lambda l: NOT (regexp_matches(trim(l), '^[—-]\\s*\\d+\\s*[—-]$') OR regexp_matches(trim(l), '^\\d+\\s*/\\s*\\d+$') OR regexp_matches(trim(l), '^_{{3,}}$') OR regexp_matches(trim(l), '[|｜]\\s*试题卷$')
  OR regexp_matches(trim(l), '(?i)^Part\\s+[IVX\\d]+\\s+.*(continued|Choices for Questions)') OR regexp_matches(trim(l), '(?i)^Passage\\s+(\\d+|One|Two|Three|Four)\\s*[—–-]\\s*Questions') OR l LIKE '%绝密%')),
 lambda l: rtrim(l)), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')"""


@query("T1", f"SELECT doc_id, page, {_STRIPPED} AS text FROM v_noisy_pages")
def _clean(r):
    return pg.clean_pages(r.v_noisy_pages)


@query("T2", f"""WITH c AS (SELECT doc_id, page, {_STRIPPED} AS t FROM v_noisy_pages)
SELECT doc_id, page, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS inline_text,
 array_to_string(list_filter(list_transform(string_split_regex(t, '\\n\\s*\\n'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> ''), chr(10) || chr(10)) AS paragraph_text,
 array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda p: trim(regexp_replace(p, '[ \\t]+', ' ', 'g'))), lambda p: p <> ''), chr(10)) AS line_text
FROM c""")
def _forms(r):
    return pg.cleaned_forms(r.v_noisy_pages)


_EXAMS = """h AS (SELECT doc_id, page, (doc_id + page) % 2 = 0 AS fresh FROM v_exam_pages WHERE (doc_id + page) % 3 = 0),
s AS (SELECT doc_id, page FROM h WHERE fresh OR page = (SELECT min(page) FROM h h2 WHERE h2.doc_id = h.doc_id)),
exams AS (SELECT doc_id, page AS start_page, coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY page) - 1, (SELECT max(page) FROM v_exam_pages p WHERE p.doc_id = s.doc_id)) AS end_page FROM s)"""


@query("T3", f"WITH {_EXAMS} SELECT * FROM exams")
def _exams(r):
    return pg.split_exams(r.v_exam_pages)


@query("T4", """SELECT doc_id, page, '2024年某省学士学位英语考试' || CASE WHEN doc_id % 2 = 0 THEN ' 真题汇编（一）' ELSE '' END AS title FROM v_titled_pages WHERE page % 2 = 0""")
def _titles(r):
    return pg.exam_title(r.v_titled_pages)


@query("T5", f"""WITH {_EXAMS}, e AS (SELECT * FROM exams UNION ALL SELECT DISTINCT doc_id, 1000000, 1000001 FROM exams)
SELECT e.doc_id, start_page, end_page, p.page FROM e JOIN v_exam_pages p ON p.doc_id = e.doc_id
WHERE p.page BETWEEN start_page AND end_page OR NOT EXISTS (SELECT 1 FROM v_exam_pages q WHERE q.doc_id = e.doc_id AND q.page BETWEEN start_page AND end_page)""")
def _scoped(r):
    exams = pg.split_exams(r.v_exam_pages)
    outside = exams.select("doc_id", F.lit(1000000).cast("bigint").alias("start_page"), F.lit(1000001).cast("bigint").alias("end_page"))
    return pg.scope_pages(exams.unionByName(outside), r.v_exam_pages)


@query("T6", """WITH n AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM v_ocr_pages)
SELECT a.doc_id, a.i AS window_no, b.page FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 1 WHERE a.i <= greatest(a.n - 1, 1)""")
def _windows(r):
    return pg.page_windows(r.v_ocr_pages)


@query("T7", """WITH d AS (SELECT doc_id, count(*) AS n FROM v_ocr_pages GROUP BY doc_id),
p AS (SELECT doc_id, page AS exam_no, page * 3 - 5 AS s, CASE WHEN page = 2 THEN NULL ELSE 10 - page END AS e FROM v_ocr_pages WHERE doc_id % 4 <> 0),
c AS (SELECT p.doc_id, exam_no, greatest(1, least(n, s)) AS start_page, e, n FROM p JOIN d USING (doc_id))
SELECT doc_id, exam_no, start_page, greatest(start_page, least(n, coalesce(e, n))) AS end_page FROM c
UNION ALL SELECT doc_id, 1, 1, n FROM d WHERE doc_id % 4 = 0""")
def _clamped(r):
    proposals = r.v_ocr_pages.filter("doc_id % 4 <> 0").selectExpr(
        "doc_id", "page AS exam_no", "page * 3 - 5 AS start_page", "CASE WHEN page <> 2 THEN 10 - page END AS end_page"
    )
    return pg.clamp_exam_ranges(proposals, r.v_ocr_pages.groupBy("doc_id").agg(F.count("*").alias("n_pages")))


_OFFSETS = """o AS (SELECT doc_id, page, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_pos, length(text) AS len FROM v_ocr_pages),
off AS (SELECT doc_id, page, CAST(start_pos AS BIGINT) AS start_pos, CAST(start_pos + len AS BIGINT) AS end_pos FROM o)"""


@query("T8", f"WITH {_OFFSETS} SELECT * FROM off")
def _offsets(r):
    return pg.page_offsets(r.v_ocr_pages)


@query("T9", f"""WITH {_OFFSETS}, s AS (SELECT doc_id, page AS span_id, start_pos + 10 AS a, end_pos + 50 AS b FROM off UNION ALL SELECT doc_id, 1000000 + page, end_pos + 1000000000, end_pos + 1000000009 FROM off),
h AS (SELECT s.doc_id, span_id, page FROM s JOIN off ON off.doc_id = s.doc_id AND a < end_pos AND b > start_pos)
SELECT * FROM h UNION ALL SELECT s.doc_id, span_id, (SELECT min(page) FROM off WHERE off.doc_id = s.doc_id) FROM s WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = s.doc_id AND h.span_id = s.span_id)""")
def _span_pages(r):
    offsets = pg.page_offsets(r.v_ocr_pages)
    spans = offsets.selectExpr("doc_id", "page AS span_id", "start_pos + 10 AS span_start", "end_pos + 50 AS span_end").union(
        offsets.selectExpr("doc_id", "1000000 + page", "end_pos + 1000000000", "end_pos + 1000000009")
    )
    return pg.pages_for_spans(spans, offsets)


_KIND = "CASE section_no WHEN 1 THEN 'choice' WHEN 2 THEN 'cloze' WHEN 3 THEN 'reading' WHEN 4 THEN 'translation' ELSE 'writing' END"


@query("T10", f"""WITH s AS (SELECT paper_id, section_no, section_title, min(number) * 2 - 1 AS a FROM v_questions GROUP BY ALL), m AS (SELECT paper_id, max(number) * 2 AS z FROM v_questions GROUP BY paper_id)
SELECT paper_id, CAST(section_no AS VARCHAR) AS part_number, section_title AS title, CASE WHEN section_no = 1 THEN 20 ELSE 0 END AS minutes, CASE WHEN section_no = 1 THEN 30.0 ELSE 0.0 END AS points,
 a AS start_line, coalesce(lead(a) OVER (PARTITION BY paper_id ORDER BY a) - 1, z) AS end_line, {_KIND} AS kind FROM s JOIN m USING (paper_id)""")
def _blocks(r):
    return pg.part_blocks(r.v_part_lines)


@query("T11", """SELECT DISTINCT paper_id, CAST(section_no AS VARCHAR) AS part_number, section_title AS title, CASE WHEN section_no = 1 THEN 20 END AS minutes, CASE WHEN section_no = 1 THEN 30.0 END AS points,
 'Directions: part ' || section_no || ' text' || CASE WHEN section_no = 2 THEN chr(10) || 'mark it in the centre.' ELSE '' END AS directions FROM v_questions""")
def _meta(r):
    return pg.part_metadata(r.v_direction_lines)


@query("T12", f"""WITH h AS (SELECT *, CASE WHEN line LIKE 'Part %' THEN 'part-' || split_part(line, ' ', 2) END AS hd FROM v_part_lines),
c AS (SELECT paper_id, page, line_no, line, coalesce(last_value(hd IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY line_no), 'unscoped') AS scope FROM h)
SELECT *, CASE scope WHEN 'part-I' THEN 'choice' WHEN 'part-II' THEN 'cloze' WHEN 'part-III' THEN 'reading' WHEN 'part-IV' THEN 'translation' WHEN 'part-V' THEN 'writing' END AS scope_kind FROM c""")
def _scoped_lines(r):
    return pg.scope_lines(r.v_part_lines)


@query("T13", """SELECT b.doc_id, b.page, CASE b.page % 3 WHEN 0 THEN 'Directions: mark it in the centre.' WHEN 1 THEN 'Directions: pick one' ELSE '' END AS directions,
 CASE b.page % 3 WHEN 0 THEN ' ' || p.text WHEN 1 THEN '1. ' || p.text ELSE p.text END AS body FROM v_block_texts b JOIN v_ocr_pages p USING (doc_id, page)""")
def _directions(r):
    return pg.split_directions(r.v_block_texts)


@query("T14", """SELECT l.paper_id, q.number * 2 AS start_line, q.number, l.line_no, l.line FROM v_question_lines l JOIN v_questions q ON q.paper_id = l.paper_id AND q.number = l.line_no // 2""")
def _numbered(r):
    return pg.numbered_blocks(r.v_question_lines, ["paper_id"])


@query("T15", """SELECT paper_id, number, 'single_choice' AS type, stem, 'A=' || opt_a || '|B=' || opt_b || '|C=' || trim(opt_c) || '|D=' || opt_d AS options FROM v_questions""")
def _choices(r):
    return pg.choice_options(pg.numbered_blocks(r.v_question_lines, ["paper_id"]), ["paper_id"])


@query("T16", """SELECT paper_id, 'part-IV' AS scope, number, 'short_answer' AS type, trim(stem || ' x') AS stem FROM v_questions WHERE section_no = 4""")
def _short(r):
    lines = pg.scope_lines(r.v_part_lines).filter("scope = 'part-IV'")
    keys = ["paper_id", "scope"]
    return pg.short_answers(pg.numbered_blocks(lines, keys), keys)


_PASSAGES = """SELECT paper_id, CASE WHEN number < 45 THEN '1' ELSE '2' END AS passage, 'text before question ' || CASE WHEN number < 45 THEN 41 ELSE 45 END AS description, count(*) AS n_questions, min(number) AS first_number, max(number) AS last_number,
 (2 * 2000 + max(t)) // (2 * max(t)) / 100.0 AS score FROM (SELECT *, count(*) OVER (PARTITION BY paper_id) AS t FROM v_questions WHERE section_no = 3) GROUP BY ALL"""


def reading_passages(r) -> DataFrame:
    lines = pg.scope_lines(r.v_passage_lines).filter("scope = 'part-III'")
    points = pg.part_blocks(r.v_passage_lines).filter("part_number = '3'").select("paper_id", "points")
    return pg.passages(lines, points)


@query("T17", _PASSAGES)
def _passages(r):
    return reading_passages(r)


@query("T18")
def _cloze_contexts(r):
    return pg.cloze_contexts(r.v_cloze.select("doc_id", "number"), r.v_cloze.select("doc_id", "text"))


@query("T19", """WITH t AS (SELECT doc_id, number, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM v_cloze)
SELECT doc_id, number, trim(regexp_extract(split_part(t, '__21__', 1), '([^.!?。！？]*)$', 1) || '__21__' || regexp_extract(substr(t, instr(t, '__21__') + 6), '^([^.!?。！？]*[.!?。！？]?)', 1)) AS sentence FROM t""")
def _cloze_sentence(r):
    return pg.cloze_sentence(r.v_cloze)


@query("T20", """WITH d AS (SELECT paper_id, section_no, min(description) AS description FROM v_passages WHERE section_no = 2 GROUP BY ALL),
c AS (SELECT paper_id, number, section_no, arg_max(stem, CASE WHEN stem LIKE 'Blank %' THEN 0 ELSE 1000 END + length(stem) - chunk * 0.1) AS stem, min(answer) AS answer FROM v_chunks WHERE section_no = 2 GROUP BY ALL)
SELECT c.paper_id, section_no, number, CASE WHEN trim(stem) = '' THEN 'Blank ' || number ELSE stem END AS stem, answer,
 CASE WHEN c.paper_id % 2 = 0 THEN 'passage ' || c.paper_id ELSE d.description END AS description FROM c JOIN d USING (paper_id, section_no)""")
def _repair_cloze(r):
    chunks = r.v_chunks.filter("section_no = 2")
    sections = r.v_passages.groupBy("paper_id", "section_no", "section_title").agg(F.min("description").alias("description"))
    from_pages = r.v_papers.filter("paper_id % 2 = 0").select("paper_id", F.concat(F.lit("passage "), F.col("paper_id").cast("string")).alias("description"))
    return pg.repair_cloze(mg.merge_questions(chunks, ["paper_id", "section_title", "number"]), sections, from_pages)


@query("T21", f"""WITH p AS ({_PASSAGES}), n AS (SELECT paper_id, CAST(sum(n_questions) AS BIGINT) AS n FROM p GROUP BY paper_id)
SELECT s.paper_id, s.section_no, s.section_title, CASE WHEN s.section_no = 3 AND n.n IS NOT NULL AND s.total_score = 0 THEN 20.0 ELSE CAST(s.total_score AS DOUBLE) END AS total_score,
 CASE WHEN s.section_no = 3 AND n.n IS NOT NULL THEN (2 * 100 * CASE WHEN s.total_score = 0 THEN 20 ELSE s.total_score END + n.n) // (2 * n.n) / 100.0 ELSE CAST(s.score AS DOUBLE) END AS score,
 CASE WHEN s.section_no = 3 AND n.n IS NOT NULL THEN n.n ELSE s.n_questions END AS n_questions FROM v_sections s LEFT JOIN n USING (paper_id)""")
def _repair_reading(r):
    return pg.repair_reading(r.v_sections, reading_passages(r))


@query("T22", """WITH m AS (SELECT *, 'Directions: part ' || section_no || ' text' || CASE WHEN section_no = 2 THEN chr(10) || 'mark it in the centre.' ELSE '' END AS g FROM v_described_sections)
SELECT paper_id, section_no, section_title, CASE WHEN section_no IN (2, 3) THEN g || CASE paper_id % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || chr(10) || 'body text' ELSE chr(10) || chr(10) || description END
 WHEN description = '' OR length(g) > length(description) THEN g ELSE description END AS description FROM m""")
def _repair_parts(r):
    return pg.repair_parts(r.v_described_sections, pg.part_metadata(r.v_direction_lines))


@query("T23", """WITH f AS (SELECT paper_id FROM v_questions GROUP BY paper_id HAVING count(*) = 54)
SELECT DISTINCT paper_id, CAST(section_no AS VARCHAR) AS part_number, section_title AS title, 20 AS duration_minutes, CASE section_no WHEN 1 THEN 30.0 WHEN 2 THEN 20.0 WHEN 3 THEN 20.0 ELSE 15.0 END AS total_score,
 CASE section_no WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 WHEN 3 THEN 2.5 WHEN 4 THEN 3.0 ELSE 15.0 END AS score, CASE section_no WHEN 1 THEN 20 WHEN 2 THEN 20 WHEN 3 THEN 8 WHEN 4 THEN 5 ELSE 1 END AS n_questions
FROM v_questions JOIN f USING (paper_id)""")
def _standard(r):
    return pg.build_standard(r.v_passage_lines)


@query("T24", f"""WITH i AS (SELECT * FROM v_cet_items), whole AS (SELECT paper_id FROM i GROUP BY paper_id HAVING count(*) = 57 AND count(*) FILTER (part_key % 331 = 0 AND number BETWEEN 1 AND 25) = 0),
p AS (SELECT paper_id, CASE WHEN trim(title) <> '' THEN title ELSE 'CET-4 ' || paper_id || '.v1' END AS title FROM v_cet_papers JOIN whole USING (paper_id) WHERE original_name LIKE 'CET%'),
w AS (SELECT paper_id, string_agg(substr('ABCDEFGHIJKLMNO', number, 1) || '=' || p_brand, '|' ORDER BY number) AS words FROM i WHERE number BETWEEN 1 AND 15 GROUP BY paper_id),
d AS (SELECT paper_id, string_agg(CASE WHEN number = 30 THEN chr(10) ELSE '' END || 'text __' || number || '__ ' || p_name, chr(10) ORDER BY number) FILTER (number BETWEEN 26 AND 35) AS blanks,
 max(CASE WHEN number = 36 THEN 'A)  ' || p_name || chr(10) || 'B) ' || p_type END) AS letters, max(CASE WHEN number = 46 THEN 'about ' || p_name END) AS one, max(CASE WHEN number = 51 THEN 'about ' || p_name END) AS two FROM i GROUP BY paper_id),
s AS (SELECT *, CASE WHEN number = 0 THEN 0 WHEN number <= 15 THEN 1 WHEN number <= 25 THEN 2 WHEN number <= 35 THEN 3 WHEN number <= 45 THEN 4 WHEN number <= 55 THEN 5 ELSE 6 END AS section_no FROM i)
SELECT paper_id, title, section_no, ['writing', 'listening', 'listening', 'wordbank', 'matching', 'reading', 'translation'][section_no + 1] AS kind,
 ['作文', '听力（第 1—15 题）', '听力（第 16—25 题）', '选词填空', '阅读匹配', '阅读', '汉译英'][section_no + 1] AS section_title, [15.0, 15.0, 20.0, 5.0, 10.0, 20.0, 15.0][section_no + 1] AS total_score,
 CASE WHEN section_no = 5 THEN CASE WHEN number <= 50 THEN 'Passage One' ELSE 'Passage Two' END END AS group_title, CASE number WHEN 0 THEN '作文' WHEN 56 THEN '翻译' ELSE CAST(number AS VARCHAR) END AS number,
 CASE number WHEN 0 THEN 'essay' WHEN 56 THEN 'short_answer' ELSE 'single_choice' END AS type,
 CASE WHEN section_no IN (0, 6) THEN 'Write about ' || p_name WHEN section_no IN (1, 2) THEN '{cet.AUDIO_STEM}' WHEN section_no = 3 THEN '第 ' || number || ' 空' ELSE trim(p_name) END AS stem,
 CASE WHEN section_no IN (0, 6) THEN '' WHEN section_no = 3 THEN words WHEN section_no = 4 THEN 'A=对应 A 段|B=对应 B 段' ELSE 'A=' || p_brand || '|B=' || p_type || '|C=' || sized || '|D=none' END AS options,
 [15.0, 1.0, 2.0, 0.5, 1.0, 2.0, 15.0][section_no + 1] AS score,
 CASE WHEN section_no IN (1, 2) THEN '{cet.AUDIO_NOTE}' WHEN section_no = 3 THEN blanks WHEN section_no = 4 THEN letters WHEN section_no = 5 AND number <= 50 THEN one WHEN section_no = 5 THEN two ELSE '' END AS description,
 CAST(number // 10 + 1 AS VARCHAR) AS source_pages FROM s JOIN p USING (paper_id) JOIN w USING (paper_id) JOIN d USING (paper_id)""")
def _cet4(r):
    rows = cet.build_cet4(r.v_cet_papers, r.v_cet_lines)
    pairs = F.transform("options", lambda o: F.concat(o["id"], F.lit("="), o["text"]))
    return rows.withColumns({"options": F.array_join(pairs, "|"), "source_pages": F.array_join(F.col("source_pages").cast("array<string>"), ",")})


@query("T25", "SELECT paper_id, CAST(number AS VARCHAR) AS number, trim(stem || ' x') AS stem FROM v_questions WHERE section_no = 5")
def _writing(r):
    scoped = pg.scope_lines(r.v_part_lines).filter("scope = 'part-V' AND line NOT LIKE 'Part %'")
    return pg.writing_question(scoped, r.v_questions.filter("section_no < 5").select("paper_id", "number"))


@query("T26", """SELECT stem AS word FROM v_questions UNION SELECT opt_a FROM v_questions UNION SELECT opt_b FROM v_questions UNION SELECT opt_c FROM v_questions UNION SELECT opt_d FROM v_questions
UNION SELECT description FROM v_passages WHERE group_no IS NOT NULL""")
def _words(r):
    q = r.v_questions.select("stem", F.array("opt_a", "opt_b", "opt_c", "opt_d").alias("options"))
    return pg.exam_words(q, r.v_passages.filter("group_no IS NOT NULL"))
