"""W*, B* and M*: mistakes ledger, submissions and the merge of windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ledger as lg, merge as mg, records as rc
from .quality import WARNING_SQL, warnings
from .registry import query

_CHOICE = "type IN ('single_choice', 'multiple_choice', 'true_false')"
_TRANSLATION = "(type IN ('translation', 'short_answer') AND regexp_matches(lower(section_title), 'translation|翻译|汉译英'))"
_WRITING = "(type IN ('essay', 'writing', 'composition') OR regexp_matches(lower(section_title), 'writing|composition|作文'))"
_EXAM_TYPE = f"""CASE WHEN {_CHOICE} AND regexp_matches(lower(section_title), 'cloze|完形|完型') THEN 'cloze'
 WHEN {_CHOICE} AND regexp_matches(lower(section_title), 'reading|阅读') THEN 'reading' WHEN {_WRITING} THEN 'writing' WHEN {_TRANSLATION} THEN 'translation' ELSE 'choice' END"""
_SAVED = f"""SELECT *, CASE WHEN is_correct = FALSE THEN 'wrong_answer' WHEN {_TRANSLATION} THEN 'translation_all' ELSE 'question_note' END AS saved_reason FROM v_graded
 WHERE {_TRANSLATION} OR ((coalesce(is_correct = FALSE, FALSE) OR coalesce(note, '') <> '') AND (coalesce(note, '') <> '' OR {_WRITING} OR trim(coalesce(student_answer, '')) <> ''))"""
_KEYS = ["learner_id", "paper_id", "question_id"]


@query("W1", f"SELECT paper_id, question_id, {_EXAM_TYPE} AS exam_type FROM v_questions")
def _exam_type(r):
    return r.v_questions.select("paper_id", "question_id", lg.exam_type(F.col("type"), F.col("section_title")).alias("exam_type"))


@query("W2", f"SELECT attempt_id, question_id, saved_reason FROM ({_SAVED})")
def _save_rule(r):
    return lg.save_rule(r.v_graded).select("attempt_id", "question_id", "saved_reason")


@query("W3", f"""SELECT learner_id, paper_id, question_id, CAST(sum(CASE WHEN is_correct = FALSE THEN 1 ELSE 0 END) AS BIGINT) AS wrong_count,
 CAST(min(submitted_at) AS VARCHAR) AS first_seen_at, CAST(max(submitted_at) AS VARCHAR) AS last_seen_at,
 last(student_answer ORDER BY submitted_at, attempt_id) AS student_answer, last(answer_key ORDER BY submitted_at, attempt_id) AS correct_answer,
 last(saved_reason ORDER BY submitted_at, attempt_id) AS saved_reason, last(tag ORDER BY submitted_at, attempt_id) FILTER (tag <> '') AS category,
 coalesce(last(note ORDER BY submitted_at, attempt_id) FILTER (note IS NOT NULL), '') AS note, CAST(max(submitted_at) FILTER (note IS NOT NULL) AS VARCHAR) AS note_updated_at
FROM ({_SAVED}) GROUP BY learner_id, paper_id, question_id""")
def _build(r):
    built = lg.ledger_build(r.v_graded, _KEYS)
    return built.withColumns({c: F.col(c).cast("string") for c in ("first_seen_at", "last_seen_at", "note_updated_at")})


# Entries after their last delete, from their first wrong grading on, with the status that an event sets.
_LIVE = """deleted AS (SELECT entry_id, max((ts, event_id)) AS d FROM v_ledger_events WHERE kind = 'delete' GROUP BY entry_id),
later AS (SELECT e.* FROM v_ledger_events e LEFT JOIN deleted USING (entry_id) WHERE d IS NULL OR (ts, event_id) > d),
opened AS (SELECT entry_id, min((ts, event_id)) AS o FROM later WHERE kind = 'graded_wrong' GROUP BY entry_id),
live AS (SELECT l.*, CASE kind WHEN 'graded_wrong' THEN 'unreviewed' WHEN 'attempt' THEN CASE WHEN is_correct THEN 'mastered' ELSE 'unreviewed' END WHEN 'patch' THEN patch_status END AS hard FROM later l JOIN opened USING (entry_id) WHERE (ts, event_id) >= o),
scanned AS (SELECT *, last_value(hard IGNORE NULLS) OVER (PARTITION BY entry_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM live),
stated AS (SELECT *, coalesce(hard, CASE WHEN kind = 'mark_reviewed' AND before <> 'mastered' THEN 'reviewed' END) AS sets FROM scanned)"""
_STATUS = f"{_LIVE}, status AS (SELECT entry_id, last(sets ORDER BY ts, event_id) FILTER (sets IS NOT NULL) AS status, count(*) FILTER (kind = 'graded_wrong') AS wrong_count FROM stated GROUP BY entry_id)"


@query("W4", f"WITH {_STATUS} SELECT entry_id, status, wrong_count FROM status")
def _status(r):
    return lg.ledger_status(r.v_ledger_events)


@query("W5", f"""WITH {_LIVE} SELECT entry_id, count(*) AS review_count, count(*) FILTER (kind = 'attempt' AND is_correct) AS correct_review_count,
 last(is_correct ORDER BY ts, event_id) FILTER (kind = 'attempt') AS last_review_correct, max(ts) AS reviewed_at
FROM scanned WHERE kind = 'attempt' OR (kind = 'mark_reviewed' AND before <> 'mastered') GROUP BY entry_id""")
def _counters(r):
    return lg.review_counters(r.v_ledger_events)


@query("W6", f"""WITH {_STATUS}, c AS (SELECT v.*, string_split(tag_list, ',') AS tags, s.entry_id IS NOT NULL AS known,
  CASE WHEN v.status NOT IN ('unreviewed', 'reviewed', 'mastered') THEN 'status' WHEN tag_list LIKE '%spelling%' THEN 'tag' END AS bad FROM v_changes v LEFT JOIN status s USING (entry_id)),
g AS (SELECT *, min(seq) FILTER (known AND bad IS NULL AND deleted) OVER (PARTITION BY entry_id) AS gone_at FROM c),
j AS (SELECT *, CASE WHEN NOT known OR coalesce(seq > gone_at, FALSE) THEN 'entry' ELSE bad END AS reason FROM g),
a AS (SELECT entry_id, last(note ORDER BY seq) FILTER (note IS NOT NULL) AS note, last(tags ORDER BY seq) FILTER (tags IS NOT NULL) AS tags, last(status ORDER BY seq) FILTER (status IS NOT NULL) AS status, max(gone_at) AS gone_at FROM j WHERE reason IS NULL GROUP BY entry_id)
SELECT 'kept' AS outcome, s.entry_id, NULL AS seq, coalesce(a.status, s.status) AS status, coalesce(trim(a.note), '') AS note, CASE WHEN tags IS NULL THEN '' ELSE 'phrase,grammar' END AS tags, NULL AS reason FROM status s LEFT JOIN a USING (entry_id) WHERE gone_at IS NULL
UNION ALL SELECT 'rejected', entry_id, seq, NULL, NULL, NULL, reason FROM j WHERE reason IS NOT NULL""")
def _changed(r):
    ledger = lg.ledger_status(r.v_ledger_events).select("entry_id", "status", F.lit("").alias("note"), F.array().cast("array<string>").alias("tags"))
    changes = r.v_changes.select("seq", "entry_id", "note", F.split("tag_list", ",").alias("tags"), "status", "deleted")
    kept, rejects = lg.apply_changes(ledger, changes)
    kept = kept.select(F.lit("kept").alias("outcome"), "entry_id", F.lit(None).cast("bigint").alias("seq"), "status", "note", F.array_join("tags", ",").alias("tags"), F.lit(None).cast("string").alias("reason"))
    none = F.lit(None).cast("string")
    return kept.unionByName(rejects.select(F.lit("rejected").alias("outcome"), "entry_id", "seq", none.alias("status"), none.alias("note"), none.alias("tags"), "reason"))


@query("W12", f"""WITH f AS (SELECT 'type' AS facet, {_EXAM_TYPE} AS value FROM v_ledger UNION ALL SELECT 'tag', category FROM v_ledger
 UNION ALL SELECT 'pending', CASE WHEN status IN ('reviewed', 'mastered') THEN NULL ELSE '' END FROM v_ledger)
SELECT facet, value, count(*) AS entries FROM f WHERE value IS NOT NULL GROUP BY facet, value""")
def _facets(r):
    return lg.facet_counts(r.v_ledger)


@query("B1", """SELECT learner_id, paper_id, record_id, CAST(mtime AS VARCHAR) AS mtime FROM (SELECT *, row_number() OVER (PARTITION BY learner_id, paper_id ORDER BY mtime DESC, is_legacy, record_id DESC) AS rn FROM v_submissions) WHERE rn = 1""")
def _latest(r):
    return rc.latest_record(r.v_submissions, ["learner_id", "paper_id"]).withColumn("mtime", F.col("mtime").cast("string"))


@query("B3", """SELECT paper_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY mtime DESC, record_id DESC) AS rn FROM v_submissions) WHERE rn <= 30""")
def _kept(r):
    return rc.keep_last_attempts(r.v_submissions, ["paper_id"]).select("paper_id", "record_id")


@query("B6", """WITH v AS (SELECT * FROM v_ranges WHERE start_pos >= 0 AND end_pos <= text_len AND end_pos > start_pos),
m AS (SELECT *, max(end_pos) OVER (PARTITION BY element ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM v),
i AS (SELECT *, sum(CASE WHEN reached IS NULL OR start_pos > reached THEN 1 ELSE 0 END) OVER (PARTITION BY element ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT element, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM i GROUP BY element, island""")
def _highlights(r):
    return rc.merge_highlights(r.v_ranges)


@query("M1", """SELECT paper_id, section_no, number,
 arg_max(coalesce(stem, ''), CASE WHEN stem LIKE 'Blank %' THEN 0 ELSE 1000000 END + length(coalesce(stem, '')) - seq * 0.00001) AS stem,
 arg_min(answer, seq) FILTER (answer IS NOT NULL AND answer <> '') AS answer, arg_max(coalesce(analysis, ''), length(coalesce(analysis, '')) - seq * 0.00001) AS analysis,
 coalesce(arg_min(type, seq) FILTER (type NOT IN ('', 'unknown')), 'unknown') AS type, array_to_string(list_sort(list(DISTINCT page)), ',') AS source_pages, min(seq) AS first_seq
FROM v_chunks GROUP BY paper_id, section_no, number""")
def _merge(r):
    return mg.merge_questions(r.v_chunks, ["paper_id", "section_no", "number"])


def _chunks(r):
    options = F.array(*[F.struct(F.lit(i).alias("id"), F.col(f"opt_{i.lower()}").alias("text")) for i in "ABC"])
    options = F.filter(options, lambda o: o["text"].isNotNull())
    return r.v_chunks.select("paper_id", "section_no", "section_title", "group_no", F.col("number").cast("string").alias("number"), "seq", F.array("page").alias("pages"), "stem", options.alias("options"))


_OPTIONS = "SELECT paper_id, section_no, number, seq, unnest(['A', 'B', 'C']) AS option_id, unnest([opt_a, opt_b, opt_c]) AS text FROM v_chunks"
_PLAIN = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
_SAME = f"""keyed AS (SELECT paper_id, number, seq, page_lo, {_PLAIN.format('opt_a')} AS a, {_PLAIN.format('opt_b')} AS b, {_PLAIN.format('opt_c')} AS c FROM v_choice_windows),
same AS (SELECT x.paper_id, x.seq, min(y.seq) AS same_as FROM keyed x JOIN keyed y ON y.paper_id = x.paper_id AND y.number = x.number AND abs(y.page_lo - x.page_lo) <= 1 AND y.seq < x.seq AND y.a = x.a AND y.b = x.b AND y.c = x.c GROUP BY x.paper_id, x.seq)"""


def _choices(r):
    options = F.array(*[F.struct(F.lit(i).alias("id"), F.col(f"opt_{i.lower()}").alias("text")) for i in "ABC"])
    return r.v_choice_windows.select("paper_id", "section_no", "section_title", F.col("number").cast("string").alias("number"), "seq", F.array("page_lo", "page_hi").alias("pages"), "stem", options.alias("options"), "half")


@query("M2", f"SELECT paper_id, section_no, number, option_id, arg_max(text, length(text) - seq * 0.00001) AS text FROM ({_OPTIONS}) WHERE text IS NOT NULL GROUP BY ALL")
def _options(r):
    rows = _chunks(r).select("paper_id", "section_no", F.col("number").cast("bigint").alias("number"), "seq", F.inline("options")).withColumnRenamed("id", "option_id")
    return mg.merge_options(rows, ["paper_id", "section_no", "number"])


@query("M3", """SELECT paper_id, arg_min(title, seq) AS title, arg_max(description, length(description) - seq * 0.00001) AS description, CAST(max(total_score) AS BIGINT) AS total_score, CAST(max(score) AS DOUBLE) AS score, min(seq) AS first_seq FROM v_section_windows GROUP BY paper_id, title""")
def _sections(r):
    return mg.merge_sections(r.v_section_windows).drop("section_key").withColumns({"total_score": F.col("total_score").cast("bigint"), "score": F.col("score").cast("double")})


@query("M4", f"WITH {_SAME} SELECT * FROM same")
def _same(r):
    return mg.same_source_choice(_choices(r))


@query("M5")
def _adopted(r):
    rows = _choices(r).withColumn("kind", tx.section_kind(F.col("section_title")))
    # Windows may name the part of a continued section differently.
    return mg.adopt_section(rows.withColumn("section_key", F.concat_ws("-", "section_no", "half")))


@query("M6")
def _variants(r):
    return mg.split_variants(_chunks(r).unionByName(_choices(r).drop("half").withColumn("seq", F.col("seq") + 1000), allowMissingColumns=True), ["paper_id", "section_no", "number"])


@query("M7", """SELECT * FROM v_noisy_chunks WHERE (trim(number) <> '' OR trim(coalesce(stem, '')) <> '') AND NOT (section_title = 'Part II Cloze' AND number = '21-40')""")
def _noise(r):
    return mg.drop_noise(r.v_noisy_chunks)


@query("M8")
def _stitched(r):
    """Each document's words in up to three windows that overlap by thirty words."""
    words = r.v_corpus.select("entry_id", F.split("text", " ").alias("w")).withColumn("third", (F.size("w") / 3).cast("int"))
    cut = lambda n: F.array_join(F.slice("w", F.greatest(F.lit(1), n * F.col("third") - 29), F.when(F.lit(n) == 2, F.size("w")).otherwise(F.col("third") + 30)), " ")
    windows = words.select("entry_id", F.posexplode(F.array(cut(0), cut(1), cut(2))).alias("window_no", "text"))
    return mg.stitch_passages(windows, ["entry_id"])


@query("M9", """SELECT paper_id, section_no, CASE WHEN group_no IS NULL THEN '其他题目' ELSE 'Passage ' || CAST(group_no AS VARCHAR) END AS group_title, number, row_number() OVER (PARTITION BY paper_id, section_no, group_no ORDER BY seq) AS place
FROM (SELECT *, max(group_no) OVER (PARTITION BY paper_id, section_no) AS most FROM v_chunks) WHERE most IS NOT NULL""")
def _groups(r):
    return mg.group_membership(r.v_chunks)


@query("M10")
def _parts(r):
    return mg.dedupe_parts(_chunks(r))


@query("M11", """WITH s AS (SELECT paper_id, section_no, min(seq) AS section_seq FROM v_chunks GROUP BY ALL)
SELECT paper_id, section_seq, seq, 'q' || CAST(row_number() OVER (PARTITION BY paper_id ORDER BY section_seq, seq) AS VARCHAR) AS question_id FROM v_chunks JOIN s USING (paper_id, section_no)""")
def _numbered(r):
    first = r.v_chunks.groupBy("paper_id", "section_no").agg(F.min("seq").alias("section_seq"))
    return mg.number_questions(r.v_chunks.join(first, ["paper_id", "section_no"]).select("paper_id", "section_seq", "seq"))


@query("M12", WARNING_SQL)
def _extraction(r):
    return warnings(r)
