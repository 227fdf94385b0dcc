"""Ledger lists and practice on hand rows: blanks, repeats, unknown entries, nulls, empty tables."""

import datetime as dt

from pyspark.sql import functions as F

from paperloom.fixtures import Roles
from paperloom.operators import records as rc, review as rv

DAY = dt.datetime(2024, 1, 1)
ENTRIES = "record_id long, entry_id string, answer string"
OWN = "entry_id string, has_options boolean, correct_answer string"
VERDICTS = "record_id long, entry_id string, is_correct boolean"


def told(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_practice_is_graded_by_the_ledgers_key(spark):
    own = spark.createDataFrame([("a", True, "AB"), ("b", True, " "), ("c", False, "x"), ("d", True, None)], OWN)
    rows = [(1, "a", "b, a"), (1, "b", "A"), (1, "c", "x"), (1, "d", "　"), (2, "a", "A"), (2, "a", "B"), (3, "gone", "A"), (4, "a", "C"), (4, "d", None)]
    verdicts = spark.createDataFrame([(1, "b", False), (1, "a", False), (1, "c", None)], VERDICTS)
    results, rejects = rv.submit_practice(spark.createDataFrame(rows, ENTRIES), own, verdicts)
    assert told(results, "record_id", "entry_id", "grading_status", "is_correct", "graded_by") == sorted([
        (1, "a", "graded", True, "key"), (1, "b", "graded", False, "scorer"), (1, "c", "pending", None, "scorer"), (1, "d", "unanswered", None, "none"),
        (4, "a", "graded", False, "key"), (4, "d", "unanswered", None, "none")], key=str)
    assert told(rejects, "record_id", "reason") == [(2, "repeated"), (3, "unknown")]
    assert told(rv.practice_events(results), "record_id", "entry_id", "kind") == [(1, "a", "attempt"), (1, "b", "attempt"), (4, "a", "attempt")]
    empty, none = rv.submit_practice(spark.createDataFrame([], ENTRIES), own, verdicts)
    assert empty.count() == 0 and none.count() == 0


def test_notes_by_id_come_before_notes_by_number(spark):
    schema = "paper_id long, entry_id string, question_id string, number long, note string, note_updated_at string"
    ledger = spark.createDataFrame([(1, "a", "q1", 1, "old", "t0"), (1, "b", "q2", 2, "same", "t0"), (1, "c", "q3", 3, None, None), (2, "d", "q1", 1, "kept", "t0"), (1, "e", "q5", None, "kept", "t0")], schema)
    notes = spark.createDataFrame([(1, "q1", " new "), (1, "1", "by number"), (1, "2", "same "), (1, "3", None), (1, "", "nameless")], "paper_id long, name string, note string")
    got = rv.sync_notes(ledger, notes, ["paper_id"], F.lit("t1"))
    assert told(got, "entry_id", "note", "note_updated_at", "updated") == [("a", "new", "t1", True), ("b", "same", "t0", False), ("c", "", "t1", True), ("d", "kept", "t0", False), ("e", "kept", "t0", False)]


def test_search_looks_into_contexts_and_orders_by_number(spark):
    schema = "learner_id long, entry_id string, paper_id long, exam_type string, status string, tags array<string>, note string, context_key string, last_seen_at timestamp_ntz, number string, section_title string, stem string"
    row = lambda e, p, n, day, key="", tags=None, note=None: (1, e, p, "reading", "reviewed", tags, note, key, DAY + dt.timedelta(days=day), n, "Reading", None)
    listed = spark.createDataFrame([row("a", 1, "10", 1, "k"), row("b", 1, "9", 1, "k", ["phrase"]), row("c", 2, "x", 5, "lost", None, " "), row("d", 2, "2", 0, "k", None, "see")], schema)
    contexts = spark.createDataFrame([("k", "Read.", "Of MICE and men")], "context_key string, directions string, passage string")
    order = lambda df: [r.entry_id for r in df.orderBy("learner_id", F.desc("paper_seen_at"), "paper_id", F.col("number_value").asc_nulls_last(), "number").collect()]
    assert order(rv.ledger_search(listed, contexts, "reading")) == ["d", "c", "b", "a"]
    assert order(rv.ledger_search(listed, contexts, "reading", query="mice")) == ["b", "a", "d"]
    assert order(rv.ledger_search(listed, contexts, "reading", tag="noted")) == ["d"] and order(rv.ledger_search(listed, contexts, "reading", tag="phrase")) == ["b"]
    assert told(rv.ledger_groups(listed, contexts), "entry_id", "group_key", "size") == [("a", "k", 3), ("b", "k", 3), ("c", "missing:c", 1), ("d", "k", 3)]


def test_records_and_drafts(spark):
    records = spark.createDataFrame([(1, 1, None, DAY), (2, 1, DAY, DAY), (3, 1, None, DAY)], "record_id long, paper_id long, draft_at timestamp_ntz, mtime timestamp_ntz")
    answers = spark.createDataFrame([(1, "q1", " "), (2, "q1", "A"), (2, "q2", None)], "record_id long, question_id string, answer string")
    later = DAY + dt.timedelta(days=3)
    attempts = spark.createDataFrame([(2, 1, later, 5.0), (2, 2, DAY, 7.0)], "record_id long, seq long, submitted_at timestamp_ntz, total_score double")
    assert told(rc.record_history(records, answers, attempts), "record_id", "answered_count", "attempt_count", "last_score", "status") == [(1, 0, 0, None, "in_progress"), (2, 1, 2, 7.0, "submitted"), (3, 0, 0, None, "new")]
    schema = "k long, saved_at string, draft string"
    server = spark.createDataFrame([(1, "2024-01-02", "s"), (2, "2024-01-02", "s"), (3, "soon", "s"), (4, None, "s"), (5, "2024-01-02", "s")], schema)
    backup = spark.createDataFrame([(1, "2024-01-03", "b"), (2, "2024-01-02", "b"), (3, "2020-01-01", "b"), (4, "never", "b"), (6, "2024-01-01", "b"), (7, "", "b")], schema)
    assert told(rc.reconcile_drafts(server, backup, ["k"]), "k", "source", "draft") == [(1, "backup", "b"), (2, "server", "s"), (3, "backup", "b"), (4, "server", "s"), (5, "server", "s"), (6, "backup", "b")]


def test_results_lie_over_the_draft(spark):
    schema = "record_id long, entry_id string, answer string, is_correct boolean"
    draft = spark.createDataFrame([(1, "a", "A", None), (1, "b", "B", True)], schema)
    results = spark.createDataFrame([(1, "a", 1, "C", False), (1, "a", 2, None, None), (1, "c", 1, "D", True)], "record_id long, entry_id string, seq long, answer string, is_correct boolean")
    rows, sent = rv.record_results(draft, results)
    assert told(rows, "entry_id", "answer", "is_correct", "revealed") == [("a", None, None, True), ("b", "B", True, False), ("c", "D", True, True)]
    assert told(sent, "record_id", "seq", "results") == [(1, 1, 2), (1, 2, 1)]


def test_answers_keep_their_parts_however_small_rows_are(spark):
    roles = Roles(spark, "/root/testdata/sf0.001")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    used = lambda df: {r[0] for r in df.select(F.spark_partition_id()).collect()}
    assert len(used(roles.v_answers)) == parts
    assert len(used(roles.once("v_answers", "attempt_id", "question_key").v_practice)) == parts
