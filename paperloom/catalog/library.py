"""R*: library, trash and generation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as jb, library as lb, trash as tr
from .registry import query

AT = "1997-07-01 06:00:00"
TERM = "12"
_DUE = f"NOT purged AND expires_at <= TIMESTAMP '{AT}'"
_CATEGORY = """CASE WHEN override_category IN ('mock', 'past', 'practice', 'other') THEN override_category WHEN regexp_matches(collection_title, '模拟|原创') THEN 'mock' WHEN collection_title LIKE '%真题%' THEN 'past'
 WHEN regexp_matches(collection_title, '专项|练习|诊断|题库|训练') THEN 'practice' ELSE 'other' END"""
_HIDDEN = "hidden AS (SELECT DISTINCT item_id FROM v_entries)"
_LISTED = f"""{_HIDDEN}, listed AS (SELECT collection_id, any_value(collection_title) AS title, any_value({_CATEGORY}) AS category, count(*) AS paper_count, CAST(sum(question_count) AS BIGINT) AS question_count
 FROM v_library WHERE NOT superseded AND 'c' || CAST(collection_id AS VARCHAR) NOT IN (SELECT item_id FROM hidden) AND 'p' || CAST(paper_id AS VARCHAR) NOT IN (SELECT item_id FROM hidden) GROUP BY collection_id)"""


def _prefixed(prefix: str, name: str):
    return F.concat(F.lit(prefix), F.col(name).cast("string"))


def _papers(r):
    return r.v_library.select(_prefixed("p", "paper_id").alias("paper_id"), _prefixed("c", "collection_id").alias("collection_id"), "question_count", "paper_title")


def _collections(r):
    rows = r.v_library.groupBy(_prefixed("c", "collection_id").alias("collection_id")).agg(
        F.first("collection_title").alias("title"), F.first("override_category").alias("override_category"), F.first("superseded").alias("superseded"))
    return lb.category_of(rows.withColumn("file_name", F.lit(None).cast("string")), list(lb.SHELVES))


def _listed(r):
    return lb.list_collections(_collections(r), _papers(r), tr.hidden_ids(r.v_entries))


@query("R1", f"WITH {_LISTED} SELECT 'c' || CAST(collection_id AS VARCHAR) AS collection_id, title, category, paper_count, question_count FROM listed")
def _list(r):
    return _listed(r).select("collection_id", "title", "category", "paper_count", "question_count")


@query("R2", f"""SELECT DISTINCT 'c' || CAST(collection_id AS VARCHAR) AS collection_id, {_CATEGORY} AS category, coalesce(override_category IN ('mock', 'past', 'practice', 'other'), FALSE) AS category_manual FROM v_library""")
def _category(r):
    return _collections(r).select("collection_id", "category", "category_manual")


@query("R3", "SELECT paper_id, coalesce(nullif(title_override, ''), paper_title) AS title FROM v_library")
def _names(r):
    return r.v_library.select("paper_id", lb.display_name(F.col("title_override"), F.col("paper_title")).alias("title"))


_SHELF_REQUESTS = "SELECT o_custkey AS owner, o_orderkey AS seq, CASE o_orderkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN '历年真题' WHEN 2 THEN repeat('x', 31) WHEN 3 THEN ' ' || lower(o_orderpriority) ELSE o_orderpriority END AS name FROM orders"
_SHELF_NAMES = "SELECT c_custkey AS owner, CASE WHEN c_custkey % 3 = 0 THEN 'past' ELSE 'shelf-old' END AS shelf_id, c_name AS name FROM customer"


@query("R4", f"""WITH requests AS ({_SHELF_REQUESTS}), custom AS ({_SHELF_NAMES}), owners AS (SELECT owner FROM requests UNION SELECT owner FROM custom),
d AS (SELECT owner, unnest(['mock', 'past', 'practice', 'other']) AS shelf_id, unnest(['原创模拟卷', '历年真题', '专项练习', '其他']) AS name FROM owners),
held AS (SELECT * FROM custom UNION ALL SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM custom c WHERE c.owner = d.owner AND c.shelf_id = d.shelf_id)),
j AS (SELECT owner, seq, trim(name) AS name, length(trim(name)) BETWEEN 1 AND 30 AS sized, EXISTS (SELECT 1 FROM held h WHERE h.owner = q.owner AND lower(h.name) = lower(trim(q.name))) AS used, row_number() OVER (PARTITION BY owner, lower(trim(name)) ORDER BY seq) AS rn FROM requests q)
SELECT 'shelf' AS part, owner, shelf_id, name FROM held UNION ALL SELECT 'shelf', owner, 'shelf-' || CAST(seq AS VARCHAR), name FROM j WHERE sized AND NOT used AND rn = 1
UNION ALL SELECT 'rejected', owner, CAST(seq AS VARCHAR), CASE WHEN NOT sized THEN 'name' ELSE 'taken' END FROM j WHERE NOT sized OR used OR rn > 1""")
def _shelves(r):
    held, rejects = lb.shelves(r.sql(_SHELF_NAMES), r.sql(_SHELF_REQUESTS))
    told = rejects.select(F.lit("rejected").alias("part"), "owner", F.col("seq").cast("string").alias("shelf_id"), F.col("reason").alias("name"))
    return held.select(F.lit("shelf").alias("part"), "owner", "shelf_id", "name").unionByName(told)


@query("R5", f"""WITH {_LISTED}, found AS (SELECT * FROM listed l WHERE category = 'past' AND (title LIKE '%{TERM}%' OR EXISTS (SELECT 1 FROM v_library v WHERE v.collection_id = l.collection_id AND paper_title LIKE '%{TERM}%'))),
f AS (SELECT 'found' AS facet, 'past' AS value, * FROM found UNION ALL SELECT 'category', category, * FROM listed UNION ALL SELECT 'category', 'all', * FROM listed)
SELECT facet, value, count(*) AS collections, CAST(sum(paper_count) AS BIGINT) AS papers, CAST(sum(question_count) AS BIGINT) AS questions, CAST(sum(paper_count) * 100 AS BIGINT) AS score FROM f GROUP BY facet, value""")
def _search(r):
    return lb.library_search(_listed(r), _papers(r), "past", TERM)


_BUSY = "busy AS (SELECT DISTINCT p.item_id FROM v_run_papers p JOIN v_runs r ON r.job_id = p.job_id WHERE r.active)"


def _busy(r):
    return r.v_run_papers.join(r.v_runs.filter("active"), "job_id", "left_semi").select("item_id").distinct()


@query("R6", f"""WITH {_HIDDEN}, {_BUSY}, m AS (SELECT i.*, item_id IN (SELECT item_id FROM hidden) AS was, item_id IN (SELECT item_id FROM busy) AS work FROM v_items i),
c AS (SELECT m.*, work OR EXISTS (SELECT 1 FROM m k WHERE k.parent_id = m.item_id AND k.work AND NOT k.was) AS held FROM m),
ok AS (SELECT q.seq, q.item_id, q.asked_at, c.kind, c.parent_id FROM v_requests q JOIN c USING (item_id) WHERE NOT was AND NOT superseded AND NOT held),
firsts AS (SELECT item_id, kind, parent_id, min(seq) AS seq, arg_min(asked_at, seq) AS asked_at FROM ok GROUP BY ALL),
roots AS (SELECT f.* FROM firsts f LEFT JOIN firsts p ON p.item_id = f.parent_id WHERE p.seq IS NULL OR p.seq > f.seq),
rows AS (SELECT seq AS entry_id, item_id AS root_id, item_id, asked_at FROM roots UNION ALL SELECT r.seq, r.item_id, m.item_id, r.asked_at FROM roots r JOIN m ON m.parent_id = r.item_id WHERE NOT m.was AND m.item_id NOT IN (SELECT item_id FROM roots)),
told AS (SELECT q.seq, q.item_id, CASE WHEN EXISTS (SELECT 1 FROM roots x WHERE x.seq = q.seq) THEN NULL WHEN q.item_id IN (SELECT item_id FROM hidden) OR w.entry_id < q.seq THEN 'hidden' WHEN c.item_id IS NULL THEN 'missing' WHEN c.superseded THEN 'superseded' ELSE 'busy' END AS reason
 FROM v_requests q LEFT JOIN c ON c.item_id = q.item_id LEFT JOIN rows w ON w.item_id = q.item_id)
SELECT 'hides' AS part, entry_id, root_id, item_id, CAST(asked_at + INTERVAL 15 DAY AS VARCHAR) AS expires_at, NULL AS reason FROM rows UNION ALL SELECT 'rejected', seq, NULL, item_id, NULL, reason FROM told WHERE reason IS NOT NULL""")
def _closure(r):
    rows, rejects = tr.trash_closure(r.v_requests, r.v_items, tr.hidden_ids(r.v_entries), _busy(r))
    none = F.lit(None).cast("string")
    told = rejects.select(F.lit("rejected").alias("part"), F.col("seq").alias("entry_id"), none.alias("root_id"), "item_id", none.alias("expires_at"), "reason")
    return rows.select(F.lit("hides").alias("part"), "entry_id", "root_id", "item_id", F.col("expires_at").cast("string").alias("expires_at"), none.alias("reason")).unionByName(told)


@query("R7", "SELECT DISTINCT item_id FROM v_entries")
def _hidden(r):
    return tr.hidden_ids(r.v_entries)


@query("R8", f"""SELECT entry_id, CASE WHEN bool_or(purged OR expires_at <= TIMESTAMP '{AT}') THEN 'expired' WHEN bool_or(i.item_id IS NULL) THEN 'missing' WHEN bool_or(EXISTS (SELECT 1 FROM v_entries o WHERE o.item_id = i.parent_id AND o.entry_id <> e.entry_id)) THEN 'parent' END AS reason
FROM v_entries e LEFT JOIN v_items i ON i.item_id = e.item_id GROUP BY entry_id""")
def _restore(r):
    return tr.restore_check(r.v_entries, r.v_items, AT)


_OVERRIDES = "SELECT 'p' || CAST(paper_id AS STRING) AS item_id FROM v_library WHERE title_override IS NOT NULL"
_SENT = "SELECT record_id, 'p' || CAST(learner_id AS STRING) AS item_id FROM v_submissions"


@query("R9", f"""WITH due AS (SELECT * FROM v_entries WHERE {_DUE}), going AS (SELECT DISTINCT item_id FROM due), away AS (SELECT item_id FROM v_entries WHERE purged UNION SELECT item_id FROM going),
there AS (SELECT * FROM v_items WHERE item_id IN (SELECT item_id FROM going))
SELECT 'paper' AS target, item_id AS key FROM there UNION ALL SELECT 'override', item_id FROM ({_OVERRIDES}) WHERE item_id IN (SELECT item_id FROM going)
UNION ALL SELECT 'submission', CAST(record_id AS VARCHAR) FROM ({_SENT}) WHERE item_id IN (SELECT item_id FROM going)
UNION ALL SELECT 'link', parent_id || '/' || item_id FROM there WHERE kind = 'paper' AND parent_id NOT IN (SELECT item_id FROM away)
UNION ALL SELECT DISTINCT 'tombstone', CAST(entry_id AS VARCHAR) FROM due""")
def _purge(r):
    return tr.purge_plan(r.v_entries, r.v_items, r.sql(_OVERRIDES), r.sql(_SENT), AT)


@query("R10", f"""WITH going AS (SELECT DISTINCT item_id FROM v_entries WHERE {_DUE}), away AS (SELECT item_id FROM v_entries WHERE purged UNION SELECT item_id FROM going),
j AS (SELECT job_id, upload, EXISTS (SELECT 1 FROM v_run_papers p WHERE p.job_id = r.job_id) AND NOT EXISTS (SELECT 1 FROM v_run_papers p WHERE p.job_id = r.job_id AND p.item_id NOT IN (SELECT item_id FROM away)) AS over FROM v_runs r),
s AS (SELECT *, coalesce(parent_id, item_id) AS source FROM v_items)
SELECT 'job' AS target, CAST(job_id AS VARCHAR) AS key FROM j WHERE over UNION ALL SELECT DISTINCT 'upload', upload FROM j WHERE over AND upload NOT IN (SELECT upload FROM j WHERE NOT over)
UNION ALL SELECT DISTINCT 'source', source FROM s WHERE item_id IN (SELECT item_id FROM going) AND NOT EXISTS (SELECT 1 FROM v_items k WHERE k.parent_id = s.source AND k.item_id NOT IN (SELECT item_id FROM away))""")
def _orphans(r):
    return tr.purge_orphans(r.v_entries, r.v_items, r.v_runs, r.v_run_papers, AT)


@query("R11", f"""SELECT entry_id, CAST(deleted_at AS VARCHAR) AS deleted_at, count(*) AS items, CAST(ceil((epoch_us(expires_at) - epoch_us(TIMESTAMP '{AT}')) / 86400000000.0) AS BIGINT) AS days_left FROM v_entries WHERE NOT purged AND expires_at > TIMESTAMP '{AT}' GROUP BY entry_id, deleted_at, expires_at""")
def _trash(r):
    return tr.list_trash(r.v_entries, AT).withColumn("deleted_at", F.col("deleted_at").cast("string"))


JOB_STATE = """SELECT job_id, CASE WHEN status = 'running' AND NOT live THEN 'interrupted' ELSE status END AS status, stage, done, total, stages
FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn FROM v_jobs) JOIN (SELECT job_id, count(DISTINCT stage) AS stages FROM v_jobs GROUP BY job_id) USING (job_id) WHERE rn = 1"""


@query("R12", JOB_STATE)
def _job_state(r):
    return jb.job_state(r.v_jobs)


@query("R13", f"""WITH {_HIDDEN}, n AS (SELECT job_id, updated_at FROM v_runs ORDER BY updated_at DESC, job_id DESC LIMIT 20)
SELECT job_id, CAST(updated_at AS VARCHAR) AS updated_at FROM n WHERE NOT EXISTS (SELECT 1 FROM v_run_papers p WHERE p.job_id = n.job_id) OR EXISTS (SELECT 1 FROM v_run_papers p WHERE p.job_id = n.job_id AND p.item_id NOT IN (SELECT item_id FROM hidden))""")
def _recent(r):
    return jb.recent_jobs(r.v_runs, r.v_run_papers, tr.hidden_ids(r.v_entries)).withColumn("updated_at", F.col("updated_at").cast("string"))


@query("R14", """SELECT job_id, CASE WHEN bool_or(coalesce(status, '') = 'incomplete') THEN 'incomplete' WHEN bool_or(coalesce(status, '') = 'review') THEN 'review' ELSE 'completed' END AS status FROM v_run_papers GROUP BY job_id""")
def _outcome(r):
    return jb.job_outcome(r.v_run_papers)


_STANDARD = "SELECT doc_id FROM v_ocr_pages GROUP BY doc_id HAVING min(length(text)) < 40"


@query("R15", f"""WITH n AS (SELECT doc_id, count(*) AS pages FROM v_ocr_pages GROUP BY doc_id), w AS (SELECT doc_id, unnest(range(1, greatest(1, pages - 1) + 1)) AS window_no FROM n),
s AS ({_STANDARD}) SELECT w.doc_id, CAST(CASE WHEN s.doc_id IS NULL THEN count(c.window_no) ELSE 0 END AS BIGINT) AS done, CASE WHEN s.doc_id IS NULL THEN count(*) ELSE 0 END AS total, CASE WHEN s.doc_id IS NULL THEN 0 ELSE 1 END AS standard_papers
FROM w LEFT JOIN (SELECT DISTINCT doc_id, window_no FROM v_cached) c ON c.doc_id = w.doc_id AND c.window_no = w.window_no LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id, s.doc_id""")
def _progress(r):
    return jb.extract_progress(r.v_ocr_pages, r.v_cached, r.sql(_STANDARD))


@query("R16", """WITH i AS (SELECT * FROM v_issues WHERE code NOT IN ('unconfirmed_format', 'no_source')), c AS (SELECT DISTINCT paper_id, chunk * 100 + number AS chunk, page FROM v_chunks)
SELECT paper_id, chunk, bool_and(EXISTS (SELECT 1 FROM i WHERE i.paper_id = c.paper_id) AND NOT EXISTS (SELECT 1 FROM i WHERE i.paper_id = c.paper_id AND (i.page IS NULL OR i.page = c.page))) AS reused FROM c GROUP BY paper_id, chunk""")
def _repair(r):
    return jb.repair_plan(r.v_chunks.select("paper_id", (F.col("chunk") * 100 + F.col("number")).alias("chunk"), "page"), r.v_issues)


_SIGNED = "paper_id, section_title, question_id, number, stem, opt_a, opt_b, opt_c, opt_d"


@query("R17", f"""WITH a AS (SELECT {_SIGNED} FROM v_questions), b AS (SELECT {_SIGNED} FROM v_corrected), d AS (SELECT DISTINCT paper_id FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))),
j AS (SELECT paper_id, paper_id IN (SELECT paper_id FROM d) AS changed, paper_id IN (SELECT paper_id FROM v_submissions WHERE status = 'F' AND duration_seconds > 480000) AS sent FROM (SELECT DISTINCT paper_id FROM b))
SELECT paper_id, changed, changed OR sent AS separate, CAST(paper_id AS VARCHAR) || CASE WHEN changed OR sent THEN '-r' ELSE '' END AS target_id FROM j""")
def _changed(r):
    signed = lambda df: df.select("paper_id", F.col("number").alias("place"), F.struct("section_title", "question_id", "number", "stem", "opt_a", "opt_b", "opt_c", "opt_d").alias("signature"))
    return jb.paper_changed(signed(r.v_questions), signed(r.v_corrected), r.v_submissions.filter("status = 'F' AND duration_seconds > 480000"))


@query("R18", """WITH s AS (SELECT doc_id, page FROM v_ocr_pages WHERE extraction_method <> 'vision_ocr')
SELECT 'read' AS part, doc_id, page AS number FROM s UNION ALL SELECT 'kept', doc_id, window_no FROM v_cached WHERE doc_id NOT IN (SELECT doc_id FROM s)""")
def _stale(r):
    pages, kept = jb.stale_ocr_pages(r.v_ocr_pages, r.v_cached)
    return pages.select(F.lit("read").alias("part"), "doc_id", F.col("page").alias("number")).unionByName(kept.select(F.lit("kept").alias("part"), "doc_id", F.col("window_no").alias("number")))
