"""W7-W17, B2, B5: work with the ledger, practice records, records of a paper."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as rc, review as rv
from .ledger import _EXAM_TYPE, _KEYS, _SAVED
from .registry import query

_AT = "2030-01-01 00:00:00"
_PAPER = ["learner_id", "paper_id"]

# One row of an entry for each of its tags, as learners gave them over time.
_TAGS = "SELECT DISTINCT CAST(learner_id AS STRING) || '__' || CAST(paper_id AS STRING) || '__' || question_id AS entry_id, tag FROM v_graded WHERE is_correct = FALSE AND tag IS NOT NULL"


def _ledger(r):
    tags = r.sql(_TAGS).groupBy("entry_id").agg(F.collect_set("tag").alias("tags"))  # of a few fixed tags
    rows = r.v_ledger.join(tags, "entry_id", "left")
    return rows.join(r.v_questions.select("paper_id", "question_id", "stem"), ["paper_id", "question_id"], "left")


@query("W3_history", f"""SELECT learner_id, paper_id, question_id, row_number() OVER (PARTITION BY learner_id, paper_id, question_id ORDER BY submitted_at, attempt_id) AS place, CAST(submitted_at AS VARCHAR) AS seen_at, student_answer, answer_key AS correct_answer
FROM ({_SAVED}) WHERE saved_reason = 'wrong_answer'""")
def _history(r):
    return rv.wrong_history(r.v_graded, _KEYS).withColumn("seen_at", F.col("seen_at").cast("string"))


@query("W12_tags", f"SELECT tag, count(*) AS entries FROM ({_TAGS}) WHERE entry_id IN (SELECT entry_id FROM v_ledger) GROUP BY tag")
def _tag_counts(r):
    return rv.tag_counts(_ledger(r))


_NOTES = """SELECT learner_id, paper_id, CASE WHEN number % 2 = 0 THEN question_id ELSE CAST(number AS STRING) END AS name, ' ' || max(note) || ' ' AS note FROM v_graded GROUP BY learner_id, paper_id, number, question_id
UNION ALL SELECT learner_id, paper_id, CAST(number AS STRING), 'by number' FROM v_ledger WHERE type = 'short_answer'"""


@query("W7", f"""WITH n AS (SELECT learner_id, paper_id, name, max(trim(coalesce(note, ''))) AS given FROM ({_NOTES}) GROUP BY ALL),
j AS (SELECT l.entry_id, l.note, coalesce(i.given, k.given) AS new FROM v_ledger l LEFT JOIN n i ON i.learner_id = l.learner_id AND i.paper_id = l.paper_id AND i.name = l.question_id
 LEFT JOIN n k ON k.learner_id = l.learner_id AND k.paper_id = l.paper_id AND k.name = CAST(l.number AS VARCHAR))
SELECT entry_id, CASE WHEN new IS NOT NULL THEN new ELSE note END AS note, new IS NOT NULL AND new IS DISTINCT FROM note AS updated, CASE WHEN new IS NOT NULL AND new IS DISTINCT FROM note THEN '{_AT}' END AS note_updated_at FROM j""")
def _synced(r):
    ledger = r.v_ledger.withColumn("note_updated_at", F.lit(None).cast("string"))
    return rv.sync_notes(ledger, r.sql(_NOTES), _PAPER, F.lit(_AT)).select("entry_id", "note", "updated", "note_updated_at")


_LISTED = f"""tagged AS ({_TAGS}), listed AS (SELECT l.learner_id, l.entry_id, l.paper_id, l.number, l.section_title, l.status, l.note, l.last_seen_at, {_EXAM_TYPE.replace('type IN', 'l.type IN').replace('section_title', 'l.section_title')} AS exam_type,
 CASE WHEN l.section_no_key IN (2, 3) THEN x.context_key ELSE '' END AS context_key,
 CASE WHEN l.section_no_key = 2 AND l.number = 21 THEN 'He saw the __21__ there.' WHEN l.section_no_key = 2 AND l.number = 30 THEN 'Then __30__ came!' ELSE q.stem END AS stem
 FROM (SELECT *, CASE WHEN number BETWEEN 21 AND 40 THEN 2 WHEN number BETWEEN 41 AND 48 THEN 3 ELSE 1 END AS section_no_key FROM v_ledger) l JOIN v_questions q USING (paper_id, question_id) JOIN v_contexts x USING (paper_id, question_id))"""


def _contexts(r):
    return r.v_contexts


def _listed(r, tag=None, status=None):
    return rv.list_ledger(_ledger(r), r.v_contexts.withColumn("context_text", F.concat_ws("\n\n", "directions", "passage")), tag, status)


def _once(r):
    return rv.ledger_contexts(_listed(r), r.v_contexts)


@query("W8", f"WITH {_LISTED} SELECT entry_id, exam_type, context_key, stem, CAST(last_seen_at AS VARCHAR) AS last_seen_at FROM listed WHERE status = 'reviewed' AND entry_id IN (SELECT entry_id FROM tagged WHERE tag = 'grammar')")
def _list(r):
    return _listed(r, "grammar", "reviewed").select("entry_id", "exam_type", "context_key", "stem", F.col("last_seen_at").cast("string").alias("last_seen_at"))


_ONCE = "once AS (SELECT context_key, max(directions) AS directions, max(passage) AS passage FROM v_contexts WHERE context_key IN (SELECT context_key FROM listed) GROUP BY context_key)"


@query("W9", f"WITH {_LISTED}, {_ONCE} SELECT * FROM once")
def _used(r):
    return _once(r)


@query("W10", f"""WITH {_LISTED}, {_ONCE}, f AS (SELECT l.* FROM listed l LEFT JOIN once o USING (context_key) WHERE exam_type = 'reading' AND trim(coalesce(note, '')) <> ''
 AND contains(lower(coalesce(section_title, '') || ' ' || number || ' ' || coalesce(stem, '') || ' ' || coalesce(note, '') || ' ' || coalesce(directions, '') || ' ' || coalesce(passage, '')), 'passage 1'))
SELECT learner_id, entry_id, paper_id, CAST(max(last_seen_at) OVER (PARTITION BY learner_id, paper_id) AS VARCHAR) AS paper_seen_at, number AS number_value FROM f""")
def _search(r):
    found = rv.ledger_search(_listed(r), _once(r), "reading", tag="noted", query="Passage 1")
    return found.select("learner_id", "entry_id", "paper_id", F.col("paper_seen_at").cast("string").alias("paper_seen_at"), "number_value")


@query("W11", f"""WITH {_LISTED}, g AS (SELECT learner_id, entry_id, CASE WHEN context_key <> '' THEN context_key ELSE 'missing:' || entry_id END AS group_key FROM listed)
SELECT *, count(*) OVER (PARTITION BY learner_id, group_key) AS size FROM g""")
def _groups(r):
    return rv.ledger_groups(_listed(r), _once(r))


_ENTRIES = "SELECT record_id, entry_key AS entry_id, answer FROM v_practice UNION ALL SELECT record_id, entry_key, answer FROM v_practice WHERE answer = 'b, a' AND type = 'essay'"
_OWN = "SELECT question_key AS entry_id, type = 'single_choice' AS has_options, answer_key AS correct_answer, CASE WHEN number % 2 = 0 THEN 'C' END AS last_review_answer, 'B' AS student_answer FROM v_kept_questions"
_VERDICTS = "SELECT attempt_id AS record_id, question_key AS entry_id, is_correct FROM v_scored"
_NORMAL = "array_to_string(list_sort(list_filter(CASE WHEN regexp_full_match(trim({0}), '[A-Za-z]{{2,}}') THEN string_split(upper(trim({0})), '') ELSE string_split_regex(upper(trim({0})), '[,，;；\\s]+') END, lambda p: p <> '')), '|')"
_RESULTS = f"""own AS ({_OWN}), named AS (SELECT record_id, entry_id, count(*) AS times, max(answer) AS answer FROM ({_ENTRIES}) GROUP BY ALL), j AS (SELECT n.*, o.entry_id IS NULL AS lost, has_options, correct_answer FROM named n LEFT JOIN own o ON o.entry_id = n.entry_id),
rejected AS (SELECT record_id, CASE WHEN max(times) > 1 THEN 'repeated' ELSE 'unknown' END AS reason FROM j GROUP BY record_id HAVING max(times) > 1 OR bool_or(lost)),
b AS (SELECT j.*, CASE WHEN trim(coalesce(answer, '')) = '' THEN 'none' WHEN has_options AND coalesce(correct_answer, '') <> '' THEN 'key' ELSE 'scorer' END AS graded_by FROM j WHERE record_id NOT IN (SELECT record_id FROM rejected)),
c AS (SELECT b.*, CASE graded_by WHEN 'key' THEN {_NORMAL.format('answer')} = {_NORMAL.format('correct_answer')} WHEN 'scorer' THEN v.verdict END AS is_correct FROM b LEFT JOIN (SELECT record_id, entry_id, max(is_correct) AS verdict FROM ({_VERDICTS}) GROUP BY ALL) v USING (record_id, entry_id)),
results AS (SELECT record_id, entry_id, answer, CASE WHEN graded_by = 'none' THEN 'unanswered' WHEN is_correct IS NULL THEN 'pending' ELSE 'graded' END AS grading_status, is_correct, graded_by FROM c)"""


_RESULT = ["attempt_id", "question_key"]


def _results(r):
    r.once("v_answers", *_RESULT)
    return rv.submit_practice(r.sql(_ENTRIES), r.sql(_OWN), r.sql(_VERDICTS))


@query("W13", f"WITH {_RESULTS} SELECT * FROM results UNION ALL SELECT record_id, NULL, NULL, reason, NULL, NULL FROM rejected")
def _submitted(r):
    results, rejects = _results(r)
    return results.unionByName(rejects.select("record_id", F.col("reason").alias("grading_status")), allowMissingColumns=True)


@query("W14", f"""WITH {_RESULTS} SELECT r.*, coalesce(last_review_answer, student_answer) AS previous_answer, correct_answer, is_correct IS NOT NULL AS counts FROM results r JOIN own USING (entry_id)""")
def _output(r):
    results, _ = _results(r)
    counted = rv.practice_events(results).select("record_id", "entry_id", F.lit(True).alias("counts"))
    return rv.practice_output(results, r.sql(_OWN)).join(counted, ["record_id", "entry_id"], "left").withColumn("counts", F.coalesce("counts", F.lit(False)))


_RECORDS = "SELECT record_id, max(exam_type) AS exam_type, max(submitted_at) AS created_at FROM v_practice GROUP BY record_id"
_DRAFT = "SELECT p.record_id, p.entry_key AS entry_id, p.answer, s.is_correct FROM v_practice p LEFT JOIN v_scored s ON s.attempt_id = p.record_id AND s.question_key = p.entry_key"
_SENT = "SELECT l_orderkey AS record_id, l_shipdate AS submitted_at FROM lineitem WHERE l_returnflag = 'R'"


@query("W15", f"""SELECT r.record_id, exam_type, CAST(created_at AS VARCHAR) AS created_at, coalesce(answered_count, 0) AS answered_count, coalesce(correct_count, 0) AS correct_count, coalesce(wrong_count, 0) AS wrong_count, coalesce(submission_count, 0) AS submission_count FROM ({_RECORDS}) r
LEFT JOIN (SELECT record_id, count(*) FILTER (answer <> '') AS answered_count, count(*) FILTER (is_correct) AS correct_count, count(*) FILTER (NOT is_correct) AS wrong_count FROM ({_DRAFT}) GROUP BY record_id) d USING (record_id)
LEFT JOIN (SELECT record_id, count(*) AS submission_count FROM ({_SENT}) GROUP BY record_id) s USING (record_id) WHERE exam_type IN ('choice', 'translation', 'reading')""")
def _records(r):
    return rv.practice_records(r.sql(_RECORDS), r.sql(_DRAFT), r.sql(_SENT)).withColumn("created_at", F.col("created_at").cast("string"))


_BATCHES = "SELECT attempt_id AS record_id, question_key + 1 AS entry_id, 1 AS seq, 'A' AS answer, is_correct FROM v_scored UNION ALL SELECT attempt_id, question_key, 2, 'D', NOT is_correct FROM v_scored WHERE score_awarded > 1"


@query("W16", f"""WITH b AS ({_BATCHES}), last AS (SELECT record_id, entry_id, arg_max(answer, (seq, answer)) AS answer, any_value(is_correct) AS v FROM (SELECT *, row_number() OVER (PARTITION BY record_id, entry_id ORDER BY seq DESC) AS rn FROM b) WHERE rn = 1 GROUP BY ALL),
d AS ({_DRAFT}) SELECT 'draft' AS part, coalesce(d.record_id, l.record_id) AS record_id, coalesce(d.entry_id, l.entry_id) AS number, CASE WHEN l.entry_id IS NULL THEN d.answer ELSE l.answer END AS answer, CASE WHEN l.entry_id IS NULL THEN d.is_correct ELSE l.v END AS is_correct, l.entry_id IS NOT NULL AS revealed
FROM d FULL JOIN last l ON l.record_id = d.record_id AND l.entry_id = d.entry_id UNION ALL SELECT 'sent', record_id, seq, CAST(count(*) AS VARCHAR), NULL, NULL FROM b GROUP BY record_id, seq""")
def _overlaid(r):
    r.once("v_answers", *_RESULT)
    rows, sent = rv.record_results(r.sql(_DRAFT), r.sql(_BATCHES))
    told = sent.select(F.lit("sent").alias("part"), "record_id", F.col("seq").cast("bigint").alias("number"), F.col("results").cast("string").alias("answer"))
    return rows.withColumnRenamed("entry_id", "number").withColumn("part", F.lit("draft")).unionByName(told, allowMissingColumns=True)


@query("W17", f"""WITH d AS ({_DRAFT}) SELECT record_id, count(*) AS entries, count(*) FILTER (trim(coalesce(answer, '')) <> '') AS answered, count(*) FILTER (is_correct) AS correct, count(*) FILTER (NOT is_correct) AS wrong, count(*) FILTER (is_correct IS NULL) AS undecided FROM d GROUP BY record_id""")
def _practice_progress(r):
    r.once("v_answers", *_RESULT)
    return rv.practice_progress(r.v_practice.select("record_id", F.col("entry_key").alias("entry_id")), r.sql(_DRAFT))


_FILES = "SELECT record_id, paper_id, CASE WHEN status = 'F' THEN mtime + INTERVAL 1 DAY END AS draft_at, mtime FROM v_submissions"
_GIVEN = "SELECT attempt_id AS record_id, question_id, answer_by_id AS answer FROM v_answers WHERE type = 'single_choice'"
_TRIES = "SELECT l_orderkey AS record_id, l_linenumber AS seq, l_shipdate AS submitted_at, l_quantity AS total_score FROM lineitem WHERE l_returnflag = 'R'"


@query("B2", f"""WITH f AS ({_FILES}), g AS (SELECT record_id, count(*) AS named, count(*) FILTER (trim(coalesce(answer, '')) <> '') AS answered FROM ({_GIVEN}) GROUP BY record_id),
t AS (SELECT record_id, submitted_at, total_score, count(*) OVER (PARTITION BY record_id) AS n, row_number() OVER (PARTITION BY record_id ORDER BY seq DESC, submitted_at DESC, total_score DESC) AS rn FROM ({_TRIES}))
SELECT f.record_id, paper_id, coalesce(answered, 0) AS answered_count, coalesce(n, 0) AS attempt_count, total_score AS last_score, CASE WHEN n > 0 THEN 'submitted' WHEN named > 0 THEN 'in_progress' ELSE 'new' END AS status, CAST(coalesce(draft_at, submitted_at, mtime) AS VARCHAR) AS updated_at
FROM f LEFT JOIN g USING (record_id) LEFT JOIN t ON t.record_id = f.record_id AND rn = 1""")
def _record_history(r):
    return rc.record_history(r.sql(_FILES), r.sql(_GIVEN), r.sql(_TRIES)).withColumn("updated_at", F.col("updated_at").cast("string"))


_SERVER = "SELECT learner_id, paper_id, CASE WHEN min(status) = 'O' THEN 'soon' ELSE CAST(max(CAST(mtime AS DATE)) AS STRING) END AS saved_at, max(notes) AS draft FROM v_submissions WHERE status <> 'P' GROUP BY learner_id, paper_id"
_BACKUP = "SELECT learner_id, paper_id, CASE WHEN max(duration_seconds) < 50000 THEN '' ELSE CAST(max(CAST(mtime AS DATE)) AS STRING) END AS saved_at, 'local' AS draft FROM v_submissions WHERE status = 'P' GROUP BY learner_id, paper_id"


@query("B5", f"""WITH s AS ({_SERVER}), b AS ({_BACKUP}), j AS (SELECT coalesce(s.learner_id, b.learner_id) AS learner_id, coalesce(s.paper_id, b.paper_id) AS paper_id, s.learner_id IS NOT NULL AS held, s.saved_at AS sa, b.saved_at AS ba, s.draft AS sd, b.draft AS bd,
 coalesce(TRY_CAST(b.saved_at AS TIMESTAMP) IS NOT NULL AND (TRY_CAST(s.saved_at AS TIMESTAMP) IS NULL OR TRY_CAST(b.saved_at AS TIMESTAMP) > TRY_CAST(s.saved_at AS TIMESTAMP)), FALSE) AS newer FROM s FULL JOIN b ON b.learner_id = s.learner_id AND b.paper_id = s.paper_id)
SELECT learner_id, paper_id, CASE WHEN newer THEN 'backup' ELSE 'server' END AS source, CASE WHEN newer THEN ba ELSE sa END AS saved_at, CASE WHEN newer THEN bd ELSE sd END AS draft FROM j WHERE newer OR held""")
def _reconciled(r):
    return rc.reconcile_drafts(r.sql(_SERVER), r.sql(_BACKUP), _PAPER)
