"""The roles played by the given tables, in SQL that Spark and DuckDB both read.

Every view is whole: it keeps all rows and whole texts of the tables it reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .functions.staging import staged

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

VIEWS["v_questions"] = """
SELECT CAST(floor(p_partkey/54.0) AS BIGINT) AS paper_id, p_partkey % 54 + 1 AS number,
 'q' || CAST(p_partkey % 54 + 1 AS STRING) AS question_id, p_partkey AS question_key,
 CASE WHEN p_partkey % 54 < 20 THEN 1 WHEN p_partkey % 54 < 40 THEN 2 WHEN p_partkey % 54 < 48 THEN 3 WHEN p_partkey % 54 < 53 THEN 4 ELSE 5 END AS section_no,
 CASE WHEN p_partkey % 54 < 20 THEN 'Part I Vocabulary and Structure (20 minutes, 30 points)' WHEN p_partkey % 54 < 40 THEN 'Part II Cloze' WHEN p_partkey % 54 < 48 THEN 'Part III Reading Comprehension' WHEN p_partkey % 54 < 53 THEN 'Part IV Translation' ELSE 'Part V Writing' END AS section_title,
 CASE WHEN p_partkey % 54 BETWEEN 40 AND 43 THEN 1 WHEN p_partkey % 54 BETWEEN 44 AND 47 THEN 2 END AS group_no,
 CASE WHEN p_partkey % 54 < 48 THEN 'single_choice' WHEN p_partkey % 54 < 53 THEN 'short_answer' ELSE 'essay' END AS type,
 CASE WHEN p_partkey % 23 = 0 THEN '' ELSE p_name END AS stem,
 p_brand AS opt_a, p_type AS opt_b, CASE WHEN p_partkey % 29 = 0 THEN ' ' ELSE 'size ' || CAST(p_size AS STRING) END AS opt_c, 'none' AS opt_d,
 CASE WHEN p_partkey % 11 = 0 OR p_partkey % 54 >= 48 THEN NULL WHEN p_partkey % 54 BETWEEN 20 AND 39 THEN substr('ABC', p_size % 3 + 1, 1) ELSE substr('ABCD', p_size % 4 + 1, 1) END AS answer_key
FROM part
"""

# The paper as extracted: some questions were lost on the way.
VIEWS["v_kept_questions"] = "SELECT * FROM v_questions WHERE question_key % 17 <> 0"

VIEWS["v_papers"] = """
SELECT paper_id, CAST(2021 + paper_id % 5 AS STRING) || ' paper ' || CAST(paper_id AS STRING) AS title,
 CASE paper_id % 3 WHEN 0 THEN 'degree' WHEN 1 THEN 'cet4' END AS exam_format,
 CASE WHEN paper_id % 6 = 0 THEN 99.0 ELSE 100.0 END AS total_score, count(*) AS question_count
FROM v_questions GROUP BY paper_id
"""

VIEWS["v_sections"] = """
SELECT paper_id, section_no, section_title, count(*) AS n_questions,
 CASE WHEN paper_id % 7 = 0 THEN 0 ELSE CASE section_no WHEN 1 THEN 30 WHEN 2 THEN 20 WHEN 3 THEN 20 WHEN 4 THEN 15 ELSE 15 END + paper_id % 3 END AS total_score,
 CASE WHEN paper_id % 2 = 0 THEN 0.0 ELSE 1.5 END AS score
FROM v_questions GROUP BY paper_id, section_no, section_title
"""

# Passage texts per section and passage; some are missing or too short.
VIEWS["v_passages"] = """
SELECT paper_id, section_no, section_title, group_no,
 CASE WHEN paper_id % 5 = 0 THEN '' WHEN paper_id % 5 = 1 THEN 'Directions: choose one.' || chr(10) || chr(10) || min(opt_b)
  ELSE 'Directions: choose one.' || chr(10) || chr(10) || repeat(min(stem) || ' ' || max(opt_b) || ' ', 8) END AS description
FROM v_questions GROUP BY paper_id, section_no, section_title, group_no
"""

VIEWS["v_answers"] = """
SELECT l.attempt_id, o.o_custkey % 20 AS learner_id, o.o_orderdate AS submitted_at, q.paper_id, q.question_id, q.number, q.question_key, q.section_no, q.section_title, q.type, q.answer_key,
 CASE WHEN l.ln % 3 = 0 THEN NULL WHEN l.ln % 5 = 0 THEN ' ' ELSE l.raw END AS answer_by_id,
 CASE WHEN l.ln % 3 = 1 THEN NULL ELSE l.raw END AS answer_by_number, l.supp
FROM (SELECT l_orderkey AS attempt_id, l_partkey, min(l_linenumber) AS ln, min(l_suppkey) AS supp,
  CASE min(l_suppkey) % 7 WHEN 4 THEN '' WHEN 5 THEN ' b ' WHEN 6 THEN 'b, a' ELSE substr('ABCD', CAST(min(l_suppkey) % 7 AS INT) + 1, 1) END AS raw
  FROM lineitem GROUP BY l_orderkey, l_partkey) l
JOIN orders o ON o.o_orderkey = l.attempt_id JOIN v_questions q ON q.question_key = l.l_partkey
"""

VIEWS["v_scored"] = """
SELECT attempt_id, paper_id, question_id, question_key,
 CASE (supp + question_key) % 5 WHEN 0 THEN NULL WHEN 1 THEN TRUE WHEN 2 THEN TRUE ELSE FALSE END AS is_correct,
 CAST((supp % 9) / 2.0 AS DOUBLE) - 1.0 AS score_awarded, CASE WHEN supp % 3 = 0 THEN answer_key ELSE 'A' END AS correct_answer,
 'reason ' || CAST(supp AS STRING) AS reason
FROM v_answers WHERE supp % 4 <> 3
"""

VIEWS["v_graded"] = """
SELECT attempt_id, learner_id, submitted_at, paper_id, question_id, number, section_title, type, answer_key, coalesce(answer_by_id, answer_by_number) AS student_answer,
 CASE WHEN answer_key IS NULL THEN NULL ELSE upper(trim(coalesce(answer_by_id, answer_by_number))) = answer_key END AS is_correct,
 CASE WHEN supp % 9 = 0 THEN 'note ' || CAST(supp AS STRING) WHEN supp % 9 = 1 THEN '' END AS note,
 CASE supp % 4 WHEN 0 THEN 'grammar' WHEN 1 THEN 'phrase' END AS tag
FROM v_answers
"""

VIEWS["v_ledger"] = """
SELECT CAST(learner_id AS STRING) || '__' || CAST(paper_id AS STRING) || '__' || question_id AS entry_id, learner_id, paper_id, question_id, number, section_title, type,
 max(submitted_at) AS last_seen_at, count(*) AS wrong_count, max(tag) AS category, max(note) AS note,
 CASE number % 3 WHEN 0 THEN 'unreviewed' WHEN 1 THEN 'reviewed' ELSE 'mastered' END AS status
FROM v_graded WHERE is_correct = FALSE GROUP BY learner_id, paper_id, question_id, number, section_title, type
"""

VIEWS["v_ledger_events"] = """
SELECT event_id, ts, 'u' || CAST(user_id AS STRING) || '__q' || CAST(event_id % 20 AS STRING) AS entry_id,
 CASE event_type WHEN 'error' THEN 'graded_wrong' WHEN 'click' THEN 'attempt' WHEN 'view' THEN 'mark_reviewed' WHEN 'purchase' THEN 'patch' ELSE CASE WHEN event_id % 50 = 0 THEN 'delete' ELSE 'note' END END AS kind,
 value > 50 AS is_correct, CASE event_id % 3 WHEN 0 THEN 'unreviewed' WHEN 1 THEN 'reviewed' ELSE 'mastered' END AS patch_status
FROM events
"""

# Batches of changes to entries, some with an unknown status or tag.
VIEWS["v_changes"] = """
SELECT event_id AS seq, entry_id, CASE WHEN kind = 'note' THEN '  note ' || CAST(event_id AS STRING) || ' ' END AS note,
 CASE WHEN kind = 'patch' THEN CASE WHEN event_id % 11 = 0 THEN 'lost' ELSE patch_status END END AS status,
 CASE WHEN kind = 'patch' AND event_id % 2 = 0 THEN CASE WHEN event_id % 13 = 0 THEN 'phrase,spelling' ELSE 'phrase,grammar,phrase' END END AS tag_list, kind = 'delete' AND event_id % 100 = 0 AS deleted
FROM v_ledger_events
"""

# The directions and the passage that a question stands under; a cloze's has two of its blanks.
VIEWS["v_contexts"] = """
SELECT paper_id, question_id, CAST(paper_id AS STRING) || ':section-' || CAST(section_no AS STRING) || CASE WHEN group_no IS NULL THEN '' ELSE ':group-' || CAST(group_no AS STRING) END AS context_key, 'Directions ' || CAST(section_no AS STRING) || '.' AS directions,
 CASE WHEN section_no = 2 THEN 'It began. He saw the __21__ there. Then __30__ came! The end' WHEN group_no IS NOT NULL THEN 'Passage ' || CAST(group_no AS STRING) || ' of paper ' || CAST(paper_id AS STRING) ELSE '' END AS passage
FROM v_questions
"""

VIEWS["v_practice"] = """
SELECT attempt_id AS record_id, submitted_at, question_key AS entry_key, paper_id, type, answer_key, supp,
 coalesce(answer_by_id, answer_by_number) AS answer, CASE WHEN number <= 40 THEN 'choice' WHEN number <= 48 THEN 'reading' ELSE 'translation' END AS exam_type
FROM v_answers
"""

VIEWS["v_submissions"] = """
SELECT o_orderkey AS record_id, o_orderkey % 38 AS paper_id, o_custkey AS learner_id, o_orderdate AS mtime, o_orderkey % 10 = 0 AS is_legacy, o_custkey % 4 AS n_attempts,
 CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'n' || CAST(o_custkey AS STRING) END AS notes, CAST(floor(o_totalprice) AS BIGINT) - 1000 AS duration_seconds, o_orderstatus AS status
FROM orders
"""

VIEWS["v_ranges"] = """
SELECT l_orderkey AS element, l_linenumber * 7 + l_suppkey % 5 AS start_pos, l_linenumber * 7 + l_suppkey % 5 + CAST(l_quantity AS BIGINT) % 12 - 1 AS end_pos, 55 AS text_len FROM lineitem
"""

VIEWS["v_tasks"] = """
SELECT o.o_orderkey AS plan_id, CAST(o.o_orderdate AS DATE) AS plan_date, l.ln AS task_id, l.ln AS ord, CAST(l.qty AS BIGINT) AS planned_minutes, CAST(floor(l.price / 10) AS BIGINT) AS actual_seconds,
 CASE l.supp % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'active' WHEN 2 THEN 'paused' WHEN 3 THEN 'completed' WHEN 4 THEN 'skipped' WHEN 5 THEN 'deferred' ELSE 'bogus' END AS status,
 CASE WHEN l.supp % 7 = 1 THEN l.ship END AS active_started_at
FROM (SELECT l_orderkey, l_linenumber AS ln, max(l_quantity) AS qty, max(l_extendedprice) AS price, min(l_suppkey) AS supp, min(l_shipdate) AS ship FROM lineitem GROUP BY l_orderkey, l_linenumber) l
JOIN orders o ON o.o_orderkey = l.l_orderkey
"""

VIEWS["v_actions"] = """
SELECT event_id, ts, user_id AS learner_id, CAST(ts AS DATE) AS plan_date, event_id % 4 AS task_id,
 CASE event_type WHEN 'view' THEN 'start' WHEN 'signup' THEN 'resume' WHEN 'click' THEN 'pause' WHEN 'purchase' THEN 'complete' ELSE CASE event_id % 10 WHEN 0 THEN 'plan_pause' WHEN 5 THEN 'plan_resume' WHEN 7 THEN 'reset' WHEN 3 THEN 'carryover' ELSE 'skip' END END AS action
FROM events
"""

VIEWS["v_plan_saves"] = """
SELECT o_orderkey AS save_seq, CAST(o_orderdate AS DATE) AS plan_date, o_custkey % 5 <> 0 AS has_tasks, o_custkey % 300 AS effective_minutes FROM orders
"""

VIEWS["v_feedback"] = """
SELECT o_orderkey AS save_seq, CAST(o_orderdate AS DATE) AS report_date, o_custkey % 200 - 20 AS actual_minutes, o_custkey % 50 AS questions_completed, o_custkey % 17 AS questions_correct FROM orders
"""

VIEWS["v_library"] = """
SELECT d.doc_id AS paper_id, d.doc_id % 50 AS collection_id, 'paper ' || CAST(d.doc_id AS STRING) AS paper_title, d.n_chars % 60 AS question_count,
 CASE (d.doc_id % 50) % 5 WHEN 0 THEN '模拟卷' WHEN 1 THEN '历年真题' WHEN 2 THEN '专项练习' ELSE 'misc' END AS collection_title,
 CASE (d.doc_id % 50) % 4 WHEN 0 THEN 'past' WHEN 1 THEN 'auto' WHEN 2 THEN 'shelf-gone' END AS override_category,
 (d.doc_id % 50) % 17 = 0 AS superseded, CASE WHEN d.doc_id % 9 = 0 THEN 'renamed ' || d.source END AS title_override
FROM documents d
"""

VIEWS["v_trash"] = """
SELECT event_id AS entry_id, user_id AS paper_id, ts AS deleted_at, ts + INTERVAL 15 DAY AS expires_at, value < 10 AS purged FROM events WHERE event_type = 'error'
"""

VIEWS["v_jobs"] = """
SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'view' THEN 'render' WHEN 'click' THEN 'ocr' WHEN 'signup' THEN 'extract' WHEN 'purchase' THEN 'validate' ELSE 'save' END AS stage,
 CASE event_id % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'review' WHEN 2 THEN 'completed' ELSE 'running' END AS status, event_id % 8 AS done, 8 AS total, user_id % 3 = 0 AS live
FROM events
"""

# Documents as papers of collections of eight.
VIEWS["v_items"] = """
SELECT 'p' || CAST(doc_id AS STRING) AS item_id, 'paper' AS kind, 'c' || CAST(CAST(floor(doc_id / 8.0) AS BIGINT) AS STRING) AS parent_id, doc_id % 31 = 0 AS superseded FROM documents
UNION ALL SELECT DISTINCT 'c' || CAST(CAST(floor(doc_id / 8.0) AS BIGINT) AS STRING), 'collection', NULL, CAST(floor(doc_id / 8.0) AS BIGINT) % 17 = 0 FROM documents
"""

# Urgent orders: those of status P are entries of the trash, those of status F requests to delete.
VIEWS["v_entries"] = """
SELECT o_orderkey AS entry_id, 'p' || CAST(o_custkey AS STRING) AS item_id, o_orderdate AS deleted_at, o_orderdate + INTERVAL 15 DAY AS expires_at, o_orderkey % 7 = 0 AS purged FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'
UNION ALL SELECT o_orderkey, 'c' || CAST(CAST(floor(o_custkey / 8.0) AS BIGINT) AS STRING), o_orderdate, o_orderdate + INTERVAL 15 DAY, o_orderkey % 7 = 0 FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_orderkey % 9 = 0
"""

VIEWS["v_requests"] = """
SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN 'c' || CAST(CAST(floor(o_custkey / 8.0) AS BIGINT) AS STRING) ELSE 'p' || CAST(o_custkey AS STRING) END AS item_id, o_orderdate AS asked_at FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
"""

# Errors put one of a user's twenty items into the trash, sign-ups take it out.
VIEWS["v_retention"] = """
SELECT 'u' || CAST(user_id AS STRING) || '-' || CAST(event_id % 20 AS STRING) AS item_id, event_id, ts, CASE event_type WHEN 'error' THEN 'trash' ELSE 'restore' END AS kind FROM events WHERE event_type IN ('error', 'signup')
"""

# Orders of status O as jobs, their lines as the papers they made.
VIEWS["v_runs"] = """
SELECT o_orderkey AS job_id, o_orderdate AS updated_at, 'u' || CAST(CAST(floor(o_orderkey / 2.0) AS BIGINT) AS STRING) AS upload, o_orderpriority = '5-LOW' AS active FROM orders WHERE o_orderstatus = 'O'
"""

VIEWS["v_run_papers"] = """
SELECT l_orderkey AS job_id, 'p' || CAST(l_suppkey AS STRING) AS item_id, CASE WHEN l_quantity > 45 THEN 'incomplete' WHEN l_quantity > 35 THEN 'review' WHEN l_quantity > 2 THEN 'passed' END AS status FROM lineitem
"""

# Which of a document's windows were read before.
VIEWS["v_cached"] = """
SELECT doc_id, page AS window_no FROM v_ocr_pages WHERE extraction_method = 'vision_ocr'
"""

VIEWS["v_issues"] = """
SELECT paper_id, CASE number % 5 WHEN 0 THEN 'no_source' WHEN 1 THEN 'unconfirmed_format' ELSE 'missing_stem' END AS code, CASE WHEN question_key % 23 = 0 AND paper_id % 4 = 0 THEN NULL ELSE number % 5 + 1 END AS page FROM v_questions WHERE stem = '' OR question_key % 29 = 0
"""

# A corrected version of each paper: some keep all, some lose questions, some change texts.
VIEWS["v_corrected"] = """
SELECT paper_id, section_title, question_id, number, CASE WHEN paper_id % 5 = 1 AND number = 7 THEN stem || '.' ELSE stem END AS stem, opt_a, opt_b, opt_c, opt_d FROM v_questions WHERE paper_id % 5 <> 2 OR number <> 11
"""

VIEWS["v_ocr_pages"] = """
SELECT conv_id AS doc_id, turn + 1 AS page, text, CASE WHEN role = 'assistant' THEN 'vision_ocr' ELSE 'pdf_text' END AS extraction_method FROM conversations
"""

VIEWS["v_exam_pages"] = """
SELECT doc_id, page, CASE WHEN (doc_id + page) % 3 = 0 THEN 'Part I Vocabulary and Structure' || chr(10) || CASE WHEN (doc_id + page) % 2 = 0 THEN '1. ' ELSE '9. ' END || text ELSE text END AS text FROM v_ocr_pages
"""

VIEWS["v_part_lines"] = """
SELECT paper_id, CAST(floor((number - 1) / 10.0) AS BIGINT) + 1 AS page, number * 2 - 1 AS line_no, section_title AS line FROM v_questions WHERE number IN (1, 21, 41, 49, 54)
UNION ALL
SELECT paper_id, CAST(floor((number - 1) / 10.0) AS BIGINT) + 1, number * 2, CAST(number AS STRING) || '. ' || stem || ' x' FROM v_questions
"""

VIEWS["v_question_lines"] = """
SELECT paper_id, number * 2 AS line_no, CAST(number AS STRING) || '. ' || stem AS line FROM v_questions
UNION ALL
SELECT paper_id, number * 2 + 1, 'A. ' || opt_a || ' B. ' || opt_b || ' C. ' || trim(opt_c) || ' D. ' || opt_d FROM v_questions
"""

# Two overlapping extraction windows over every paper. The first one cuts texts that the second
# holds whole; what only the first one holds, it holds whole.
VIEWS["v_chunks"] = """
SELECT paper_id, section_no, section_title, number, n AS chunk, (n * 100 + number) AS seq, n + number % 5 AS page, type,
 CASE WHEN n = 1 AND number % 4 = 0 AND number % 13 <> 0 THEN 'Blank ' || CAST(number AS STRING) WHEN n = 1 AND number % 13 <> 0 THEN substr(stem, 1, 6) ELSE stem END AS stem,
 CASE WHEN n = number % 2 + 1 THEN answer_key END AS answer, CASE WHEN n = 2 THEN opt_b ELSE opt_a END AS analysis,
 opt_a, CASE WHEN n = 1 AND number % 13 <> 0 THEN substr(opt_b, 1, 3) ELSE opt_b END AS opt_b, CASE WHEN n = 2 OR number % 13 = 0 THEN opt_c END AS opt_c, group_no
FROM (SELECT *, 1 AS n FROM v_questions UNION ALL SELECT *, 2 AS n FROM v_questions) c WHERE number % 13 <> 0 OR n = 1
"""

# Extracted rows with the noise of headings: no number and stem, or the range of a cloze.
VIEWS["v_noisy_chunks"] = """
SELECT paper_id, section_title, seq, CASE WHEN seq % 7 = 0 THEN ' ' WHEN seq % 11 = 0 THEN '21-40' ELSE CAST(number AS STRING) END AS number, CASE WHEN seq % 14 = 0 THEN NULL ELSE stem END AS stem FROM v_chunks
"""

# Three windows over two pages each; options differ in case and blanks, and some in their text.
VIEWS["v_choice_windows"] = """
SELECT paper_id, section_no, section_title, number, n * 100 + number AS seq, number % 5 + n AS page_lo, number % 5 + n + 1 AS page_hi, n % 2 AS half, stem,
 CASE n WHEN 1 THEN opt_a ELSE upper(opt_a) || ' ' END AS opt_a, CASE n WHEN 3 THEN replace(opt_b, ' ', '  ') ELSE opt_b END AS opt_b, CASE WHEN number % 6 = 0 AND n = 2 THEN 'other' ELSE opt_c END AS opt_c
FROM v_questions JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) w ON n <= number % 4 + 1
"""

VIEWS["v_section_windows"] = """
SELECT s.paper_id, s.section_no * 10 + n AS seq, section_title AS title, CASE WHEN n = 1 THEN substr(description, 1, 20) ELSE description END AS description, total_score * n AS total_score, score / n AS score
FROM v_sections s JOIN (SELECT paper_id, section_no, description FROM v_described_sections) d ON d.paper_id = s.paper_id AND d.section_no = s.section_no JOIN (SELECT 1 AS n UNION ALL SELECT 2) w ON n <= s.paper_id % 2 + 1
"""

VIEWS["v_blocks"] = """
SELECT p_partkey AS block_id, p_partkey % 7 + 1 AS page, CAST(p_partkey % 120 AS STRING) || chr(10) || p_name AS block_text FROM part
"""

VIEWS["v_phrase_lines"] = """
SELECT p_partkey AS line_no, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || '|||' || p_brand || '|||' || CASE p_size % 3 WHEN 0 THEN '动词短语' WHEN 1 THEN '介词短语' ELSE 'other' END || '|||' || p_type || '|||' || CAST(p_size AS STRING) AS line FROM part
"""

# Opening collocations and whole passages of the benchmark, plus pattern phrases.
VIEWS["v_phrases"] = """
SELECT item_id % 2 AS list_id, item_id AS number, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS phrase FROM benchmark
UNION ALL SELECT item_id % 2, 1000000000 + item_id, text FROM benchmark
UNION ALL SELECT n % 2, 2000000000 + n, phrase FROM (
 SELECT 1 AS n, 'of the' AS phrase UNION ALL SELECT 2, 'the ... the' UNION ALL SELECT 3, 'for/of the' UNION ALL SELECT 4, 'sb the'
 UNION ALL SELECT 5, 'between A and B' UNION ALL SELECT 6, 'OF THE' UNION ALL SELECT 7, 'is and' UNION ALL SELECT 8, 'sb sth') p
"""

VIEWS["v_corpus"] = """
SELECT doc_id AS entry_id, 2021 + doc_id % 5 AS year, CASE doc_id % 3 WHEN 0 THEN 'vocabulary' WHEN 1 THEN 'cloze' ELSE 'reading' END AS section, text FROM documents
"""

# Questions of an exam with their whole text, and a phrase list of words that stand in them.
VIEWS["v_exam_questions"] = """
SELECT question_key AS entry_id, paper_id, number AS position, section_no, CASE section_no WHEN 1 THEN 'vocabulary' WHEN 2 THEN 'cloze' WHEN 3 THEN 'reading' ELSE 'other' END AS section, CAST(2021 + paper_id % 5 AS STRING) AS year,
 stem || ' ' || opt_a || ' ' || opt_b || ' ' || trim(opt_c) || ' ' || opt_d AS text FROM v_questions
"""

VIEWS["v_stem_phrases"] = """
SELECT list_id, number, phrase FROM (
 SELECT list_id, min(number) AS number, phrase FROM (SELECT p_partkey % 2 AS list_id, p_partkey AS number, split_part(p_name, ' ', 1) || CASE p_partkey % 3 WHEN 0 THEN ' ... ' ELSE ' ' END || split_part(p_name, ' ', 2) AS phrase FROM part) p GROUP BY list_id, phrase) q
UNION ALL SELECT 0, 2000000001, 'small/large size' UNION ALL SELECT 1, 2000000002, 'sb brushed' UNION ALL SELECT 1, 2000000003, 'sb sth'
"""

VIEWS["v_cloze"] = """
SELECT doc_id, 21 AS number, substr(text, 1, 60) || ' __21__ ' || substr(text, 61) AS text FROM documents
"""

# Result of the structural checks, as stored with each paper.
VIEWS["v_quality"] = """
SELECT paper_id, CASE paper_id % 4 WHEN 0 THEN 'incomplete' WHEN 1 THEN 'review' ELSE 'ready' END AS status, paper_id % 9 = 0 AS is_collection FROM v_papers
"""

# Pages with the furniture that recognition leaves in the text.
VIEWS["v_noisy_pages"] = """
SELECT doc_id, page, '— ' || CAST(page AS STRING) || ' —' || chr(10) || '3 / 8' || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || '____' || chr(10) || 'Part II Cloze continued' || chr(10) || 'tail   ' || chr(10) || 'Passage One — Questions 1 to 5' || chr(10) || 'school | 试题卷' AS text FROM v_ocr_pages
"""

VIEWS["v_titled_pages"] = """
SELECT doc_id, page, CASE WHEN page % 2 = 0 THEN chr(10) || ' 2024年某省学士学位英语考试' || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '真题汇编（一）' || chr(10) ELSE '' END || text ELSE text END AS text FROM v_ocr_pages
"""

VIEWS["v_block_texts"] = """
SELECT doc_id, page, CASE page % 3 WHEN 0 THEN 'Directions: mark it in the centre. ' || text WHEN 1 THEN 'Intro' || chr(10) || 'Directions: pick one' || chr(10) || '1. ' || text ELSE text END AS text FROM v_ocr_pages
"""

# Part lines with directions under every heading.
VIEWS["v_direction_lines"] = """
SELECT paper_id, page, line_no * 10 AS line_no, line FROM v_part_lines
UNION ALL
SELECT paper_id, 1, number * 20 - 9, 'Directions: part ' || CAST(section_no AS STRING) || ' text' FROM v_questions WHERE number IN (1, 21, 41, 49, 54)
UNION ALL
SELECT paper_id, 1, number * 20 - 8, 'mark it in the centre. More' FROM v_questions WHERE number = 21
"""

# Part lines with two passages in the reading part; the first one has a running head.
VIEWS["v_passage_lines"] = """
SELECT paper_id, page, line_no * 10 AS line_no, line FROM v_part_lines
UNION ALL
SELECT paper_id, 1, number * 20 - CASE number WHEN 41 THEN 9 ELSE 5 END, CASE number WHEN 41 THEN 'Passage One' WHEN 43 THEN 'Passage 1' ELSE 'Passage Two' END FROM v_questions WHERE number IN (41, 43, 45)
UNION ALL
SELECT paper_id, 1, number * 20 - 4, 'text  before question ' || CAST(number AS STRING) FROM v_questions WHERE number IN (41, 45)
"""

VIEWS["v_described_sections"] = """
SELECT paper_id, section_no, section_title, CASE paper_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Directions: old.' || chr(10) || chr(10) || 'body text' ELSE 'A description that is longer than the printed directions, kept as it is' END AS description FROM v_sections
"""

# Extracted questions with the faults the checks look for.
VIEWS["v_checked_questions"] = """
SELECT paper_id, section_no, section_title, group_no, CAST(floor((number - 1) / 10.0) AS BIGINT) + 1 AS page, number AS position, type,
 CASE WHEN question_key % 31 = 0 THEN '' WHEN question_key % 37 = 0 THEN 'q5' ELSE question_id END AS question_id,
 CAST(CASE WHEN question_key % 41 = 0 THEN number - 1 ELSE number END AS STRING) AS number,
 CASE WHEN question_key % 43 = 0 THEN 'Question ' || CAST(number AS STRING) WHEN question_key % 41 IN (0, 40) THEN 'same  stem' ELSE stem END AS stem,
 CASE WHEN number > 48 THEN '' WHEN question_key % 47 = 0 THEN 'A' WHEN question_key % 53 = 0 THEN 'AAB' WHEN question_key % 19 = 0 THEN 'ABC' ELSE 'ABCD' END AS option_ids, opt_c
FROM v_kept_questions
"""

# Recognised lines of a paper: headings, numbered questions, options, blanks, declared counts, a topic.
VIEWS["v_source_lines"] = """
SELECT paper_id, page, line_no * 10 AS line_no, line FROM v_part_lines
UNION ALL SELECT paper_id, CAST(floor((number - 1) / 10.0) AS BIGINT) + 1, number * 20 + 5, 'A. ' || opt_a || ' B. ' || opt_b || ' C. ' || trim(opt_c) || ' D. ' || opt_d FROM v_questions WHERE number <= 48
UNION ALL SELECT paper_id, CAST(floor((number - 1) / 10.0) AS BIGINT) + 1, number * 20 - 9, CASE number WHEN 1 THEN '本部分共20题' ELSE '共 2 篇、 20 题' END FROM v_questions WHERE number IN (1, 21)
UNION ALL SELECT paper_id, CAST(floor((number - 1) / 10.0) AS BIGINT) + 1, number * 20 + 1, 'text __' || CAST(number AS STRING) || '__ text' FROM v_questions WHERE section_no = 2
UNION ALL SELECT paper_id, 6, number * 20 + 2, 'Topic: My School Life. Write' FROM v_questions WHERE number = 54
UNION ALL SELECT paper_id, 6, number * 20 + 3, 'Outline:' FROM v_questions WHERE number = 54
UNION ALL SELECT paper_id, 6, number * 20 + 4, '1. first point' FROM v_questions WHERE number = 54
"""

# Papers of 57 items: writing, listening 1-25, blanks 26-35, statements 36-45, choices 46-55, translation.
VIEWS["v_cet_items"] = """
SELECT CAST(floor(p_partkey / 57.0) AS BIGINT) AS paper_id, CAST(p_partkey % 57 AS INT) AS number, p_partkey AS part_key, p_name, p_brand, p_type, p_size, 'size ' || CAST(p_size AS STRING) AS sized FROM part
"""

VIEWS["v_cet_papers"] = """
SELECT paper_id, CASE WHEN paper_id % 5 = 4 THEN 'degree ' ELSE 'CET-4 ' END || CAST(paper_id AS STRING) || '.v1.pdf' AS original_name, CASE paper_id % 3 WHEN 0 THEN 'Paper ' || CAST(paper_id AS STRING) WHEN 1 THEN '' END AS title FROM v_cet_items GROUP BY paper_id
"""

# Their lines; some papers lost one, and every page repeats a line of the printer.
VIEWS["v_cet_lines"] = """
WITH l AS (
SELECT paper_id, number, part_key, 0 AS off, CASE number WHEN 0 THEN 'Part I Writing (30 minutes)' WHEN 1 THEN 'Part II' WHEN 26 THEN 'Part III Reading Comprehension' WHEN 36 THEN 'Section B' WHEN 46 THEN 'Section C' WHEN 51 THEN 'Passage Two' ELSE 'Part IV Translation' END AS line FROM v_cet_items WHERE number IN (0, 1, 26, 36, 46, 51, 56)
UNION ALL SELECT paper_id, number, part_key, 1, CASE number WHEN 1 THEN 'Listening Comprehension' WHEN 26 THEN 'Section A' WHEN 36 THEN 'A)  ' || p_name WHEN 46 THEN 'Passage One' WHEN 51 THEN 'about ' || p_name ELSE 'Write about ' || p_name END FROM v_cet_items WHERE number IN (0, 1, 26, 36, 46, 51, 56)
UNION ALL SELECT paper_id, number, part_key, 2, CASE number WHEN 36 THEN 'B) ' || p_type WHEN 46 THEN 'about ' || p_name ELSE 'Section A' END FROM v_cet_items WHERE number IN (1, 36, 46)
UNION ALL SELECT paper_id, number, part_key, 3, CASE WHEN number <= 25 THEN CAST(number AS STRING) || '. A) ' || p_brand || '  B) ' || p_type WHEN number <= 35 THEN 'text __' || CAST(number AS STRING) || '__ ' || p_name ELSE CAST(number AS STRING) || '. ' || p_name END FROM v_cet_items WHERE number BETWEEN 1 AND 55 AND (part_key % 331 <> 0 OR number > 25)
UNION ALL SELECT paper_id, number, part_key, 4, CASE WHEN number > 25 THEN 'A) ' || p_brand || ' B) ' || p_type || chr(32) ELSE '' END || 'C) ' || sized || ' D) none' FROM v_cet_items WHERE number BETWEEN 1 AND 25 OR number BETWEEN 46 AND 55
UNION ALL SELECT paper_id, number, part_key, 5, 'Questions 16 to 25 are based on what you hear.' FROM v_cet_items WHERE number = 15
UNION ALL SELECT paper_id, 35, part_key, 5 + number, substr('ABCDEFGHIJKLMNO', number, 1) || ') ' || p_brand FROM v_cet_items WHERE number BETWEEN 1 AND 15
UNION ALL SELECT paper_id, number, part_key, 50, '2024年大学英语四级真题' FROM v_cet_items WHERE number % 10 = 9)
SELECT paper_id, CAST(floor(number / 10.0) AS BIGINT) + 1 AS page, CAST(number * 100 + off AS BIGINT) AS line_no, line FROM l
"""

# One source line per document and the material kept for it.
VIEWS["v_prose_lines"] = """
SELECT doc_id AS paper_id, CAST(1 AS BIGINT) AS page, CAST(0 AS BIGINT) AS line_no, 'Part III Reading' AS line FROM documents
UNION ALL SELECT doc_id, 1, 1, replace(text, chr(10), ' ') FROM documents
"""

VIEWS["v_material"] = """
SELECT doc_id AS paper_id, 'part-III' AS section_key, 'reading' AS kind, CASE WHEN doc_id % 3 = 1 THEN 'lost' ELSE text END AS description FROM documents
"""

# Extraction windows; a failed one carries an error and sometimes the pages that failed.
VIEWS["v_windows"] = """
SELECT user_id AS paper_id, event_id AS window_no, event_id % 8 + 1 AS page, CASE WHEN event_type = 'error' THEN 'timeout ' || CAST(event_id AS STRING) END AS error,
 CASE WHEN event_id % 3 = 0 THEN event_id % 5 + 1 END AS failed_page FROM events
"""

#: What a view's tables are dealt by before its joins, in the session's number of parts. Rows of a few numbers shuffle
#: so small that adaptive execution would give one task as many of them as its memory can't hold.
DEALT = {"v_answers": {"lineitem": "l_orderkey", "orders": "o_orderkey", "v_questions": "question_key"}}

_NAME = re.compile(r"\b(" + "|".join([*TABLES, r"v_\w+"]) + r")\b")
_LITERAL = re.compile(r"'[^']*'")


def _referenced(sql: str) -> list[str]:
    bare = _LITERAL.sub("''", sql)
    names = {m for m in _NAME.findall(bare)}
    return [n for n in names if re.search(r"(?:FROM|JOIN)\s+" + n + r"\b", bare)]


class Roles:
    """Lazy access to tables and role views of one data folder: ``roles.v_answers``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                df = self.sql(VIEWS[name], DEALT.get(name, {}))
            else:
                raise AttributeError(name)
            self._made[name] = df
        return self._made[name]

    def once(self, name: str, *keys: str) -> Roles:
        """Write a view that several others read; they get it dealt by ``keys``."""
        self._made[name] = self._deal(staged(getattr(self, name), name), *keys)
        return self

    def _deal(self, df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *keys)

    def sql(self, text: str, dealt: dict[str, str] | None = None) -> DataFrame:
        """Spark SQL over tables and role views by name, without touching the catalog. ``dealt``: columns by which
        tables are dealt first."""
        names = _referenced(text)
        for name in names:
            text = re.sub(r"((?:FROM|JOIN)\s+)" + name + r"\b", r"\g<1>{" + name + "}", text)
        frames = {n: getattr(self, n) for n in names}
        for name, key in (dealt or {}).items():
            frames[name] = self._deal(frames[name], key)
        return self.spark.sql(text, **frames)


def with_views(sql: str) -> str:
    """Prefix a DuckDB query with the role views it needs."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in sorted(set(re.findall(r"\bv_\w+", _LITERAL.sub("''", text)))):
            if name in VIEWS and name not in order:
                need(VIEWS[name])
                order.append(name)

    need(sql)
    if not order:
        return sql
    views = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
