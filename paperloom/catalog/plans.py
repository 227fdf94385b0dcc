"""P*: study plans from the log of actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import plans as pl, records as rc, segments as sg
from .registry import query

AS_OF = "2030-01-01 00:00:00"
_ACTIONS = """ordered AS (SELECT *, row_number() OVER (PARTITION BY learner_id, plan_date ORDER BY ts, event_id) AS n,
  last_value(CASE WHEN action IN ('plan_pause', 'plan_resume') THEN action END IGNORE NULLS) OVER (PARTITION BY learner_id, plan_date ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM v_actions),
effective AS (SELECT * FROM ordered WHERE action NOT IN ('start', 'resume') OR coalesce(state, '') <> 'plan_pause'),
ended AS (SELECT s.learner_id, s.plan_date, s.task_id, s.n, min(s.ts) AS ts, min(x.n) AS ends, arg_min(x.ts, x.n) AS ends_at FROM effective s LEFT JOIN effective x ON x.learner_id = s.learner_id AND x.plan_date = s.plan_date AND x.n > s.n
  AND (x.action = 'plan_pause' OR (x.task_id = s.task_id AND x.action IN ('pause', 'complete', 'skip', 'reset', 'carryover')) OR (x.task_id <> s.task_id AND x.action IN ('start', 'resume')))
 WHERE s.action IN ('start', 'resume') GROUP BY s.learner_id, s.plan_date, s.task_id, s.n)"""


@query("P3", f"""WITH {_ACTIONS}, activity AS (SELECT learner_id, plan_date, task_id, ends, coalesce(min(ends_at), TIMESTAMP '{AS_OF}') AS until, min(ts) AS began FROM ended GROUP BY learner_id, plan_date, task_id, ends)
SELECT learner_id, plan_date, task_id, CAST(sum(greatest(0, (epoch_us(until) - epoch_us(began)) // 1000000)) AS BIGINT) AS actual_seconds FROM activity GROUP BY learner_id, plan_date, task_id""")
def _times(r):
    return pl.task_times(r.v_actions, AS_OF)


@query("P4", f"""WITH {_ACTIONS}, own AS (SELECT f.*, e.ends FROM effective f LEFT JOIN ended e USING (learner_id, plan_date, task_id, n) WHERE action NOT IN ('plan_pause', 'plan_resume')),
t AS (SELECT learner_id, plan_date, task_id, arg_max(action, n) AS action, max(CASE WHEN rn = 1 THEN ends END) AS ends, max(n) FILTER (action = 'reset') AS reset_n, max(n) FILTER (action = 'complete') AS complete_n, max(ts) FILTER (action = 'complete') AS complete_ts, bool_or(action = 'carryover') AS carried
 FROM (SELECT *, row_number() OVER (PARTITION BY learner_id, plan_date, task_id ORDER BY n DESC) AS rn FROM own) GROUP BY learner_id, plan_date, task_id)
SELECT learner_id, plan_date, task_id, CASE action WHEN 'pause' THEN 'paused' WHEN 'complete' THEN 'completed' WHEN 'skip' THEN 'skipped' WHEN 'reset' THEN 'pending' WHEN 'carryover' THEN 'deferred' ELSE CASE WHEN ends IS NULL THEN 'active' ELSE 'paused' END END AS status,
 CASE WHEN complete_n > coalesce(reset_n, 0) THEN complete_ts END AS completed_at, CASE WHEN carried THEN CAST(plan_date + INTERVAL 1 DAY AS DATE) END AS carried_to FROM t""")
def _status(r):
    return pl.task_status(r.v_actions)


_TASKS = """tasks AS (SELECT plan_id, plan_date, task_id, coalesce(nullif(ord, 0), row_number() OVER (PARTITION BY plan_id ORDER BY task_id)) AS ord, greatest(0, planned_minutes) AS planned_minutes, greatest(0, actual_seconds) AS actual_seconds,
 CASE WHEN status IN ('pending', 'active', 'paused', 'completed', 'skipped', 'deferred') THEN status ELSE 'pending' END AS status, active_started_at FROM v_tasks)"""
_TOTALS = f"""totals AS (SELECT plan_id, CAST(sum(planned_minutes) AS BIGINT) AS planned_minutes, CAST(sum(actual_seconds + CASE WHEN status = 'active' AND active_started_at IS NOT NULL THEN greatest(0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(active_started_at)) // 1000000) ELSE 0 END) AS BIGINT) AS actual_seconds,
 count(*) FILTER (status = 'completed') AS completed_count, count(*) AS task_count FROM tasks GROUP BY plan_id)"""


def _tasks(r):
    return pl.normalize_tasks(r.v_tasks)


@query("P1", f"WITH {_TASKS} SELECT * FROM tasks")
def _normalized(r):
    return _tasks(r)


@query("P2", f"WITH {_TASKS}, {_TOTALS} SELECT * FROM totals")
def _totals(r):
    return pl.plan_totals(_tasks(r), AS_OF)


@query("P5", f"""WITH {_TASKS}, h AS (SELECT plan_date, count(*) AS held FROM tasks GROUP BY plan_date), m AS (SELECT CAST(plan_date + INTERVAL 1 DAY AS DATE) AS plan_date, plan_date AS carried_from, plan_id, task_id, ord FROM tasks WHERE status = 'deferred')
SELECT m.plan_date, plan_id, task_id, coalesce(held, 0) + row_number() OVER (PARTITION BY m.plan_date ORDER BY plan_id, ord, task_id) AS ord, 'pending' AS status, 0 AS actual_seconds, carried_from FROM m LEFT JOIN h ON h.plan_date = m.plan_date""")
def _carried(r):
    return pl.carry_over(_tasks(r))


@query("P6", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY plan_date ORDER BY save_seq) AS version, lead(save_seq) OVER (PARTITION BY plan_date ORDER BY save_seq) AS replaced_by FROM v_plan_saves)
SELECT 'version' AS part, save_seq, plan_date, version FROM n UNION ALL SELECT 'history', save_seq, plan_date, replaced_by FROM (SELECT * FROM n WHERE has_tasks AND replaced_by IS NOT NULL ORDER BY replaced_by DESC LIMIT 100)""")
def _versions(r):
    versions, history = pl.plan_versions(r.v_plan_saves)
    kept = history.select(F.lit("history").alias("part"), "save_seq", "plan_date", F.col("replaced_by").alias("version"))
    return versions.select(F.lit("version").alias("part"), "save_seq", "plan_date", "version").unionByName(kept)


@query("P7", """SELECT report_date, greatest(0, arg_max(actual_minutes, save_seq)) AS actual_minutes, greatest(0, arg_max(questions_completed, save_seq)) AS questions_completed, greatest(0, arg_max(questions_correct, save_seq)) AS questions_correct FROM v_feedback GROUP BY report_date""")
def _reports(r):
    return pl.daily_reports(r.v_feedback)


@query("P8", f"""WITH {_TASKS} SELECT plan_id, coalesce(string_agg('task ' || CAST(task_id AS VARCHAR), '、' ORDER BY ord, task_id) FILTER (status = 'completed'), '无') AS completed,
 coalesce(string_agg('task ' || CAST(task_id AS VARCHAR), '、' ORDER BY ord, task_id) FILTER (status NOT IN ('completed', 'skipped')), '无') AS unfinished FROM tasks GROUP BY plan_id""")
def _lists(r):
    return pl.report_lists(_tasks(r).withColumn("title", F.concat(F.lit("task "), F.col("task_id").cast("string"))))


@query("P9", f"WITH {_TASKS}, {_TOTALS} SELECT plan_id, CASE WHEN planned_minutes > 0 THEN least(100, CAST(round(CAST(actual_seconds AS DECIMAL(18,0)) * 100 / (planned_minutes * 60), 0) AS BIGINT)) ELSE 0 END AS progress FROM totals")
def _progress(r):
    return pl.plan_progress(pl.plan_totals(_tasks(r), AS_OF))


@query("B4", """SELECT learner_id, paper_id, arg_max(record_id, (mtime, record_id)) AS record_id, arg_max(notes, (mtime, record_id)) FILTER (notes IS NOT NULL) AS notes, greatest(0, arg_max(duration_seconds, (mtime, record_id))) AS duration_seconds
FROM v_submissions GROUP BY learner_id, paper_id""")
def _drafts(r):
    return rc.draft_upsert(r.v_submissions, ["learner_id", "paper_id"])


@query("S6", r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents), b AS (SELECT doc_id, string_split_regex(t, '\n\s*\n') AS w FROM d WHERE t <> ''),
p AS (SELECT doc_id, unnest(w) AS block, unnest(range(1, len(w) + 1)) AS i FROM b), l AS MATERIALIZED (SELECT *, length(block) AS n FROM p),
s AS (SELECT doc_id, i, n AS held, 1 AS page FROM l WHERE i = 1 UNION ALL
 SELECT l.doc_id, l.i, CASE WHEN s.held + l.n > 6000 THEN l.n ELSE s.held + l.n END, s.page + CASE WHEN s.held + l.n > 6000 THEN 1 ELSE 0 END FROM s JOIN l ON l.doc_id = s.doc_id AND l.i = s.i + 1)
SELECT doc_id, CAST(page AS BIGINT) AS page, string_agg(block, chr(10) || chr(10) ORDER BY i) AS text FROM s JOIN l USING (doc_id, i) GROUP BY doc_id, page""")
def _segments(r):
    return sg.segment_documents(r.documents)
