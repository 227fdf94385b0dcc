"""Working with the mistakes ledger: notes, lists, contexts, search, and practice of its entries.

Lists come unordered with the columns to order them by, so no row needs a place among all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.answers import has_answer, normalize_answer
from ..functions.scans import Running, running
from . import ledger as lg
from .pages import cloze_sentence

# Exam types whose entries share a text, and those with practice records.
WITH_CONTEXT = ["cloze", "reading"]
PRACTISED = ["choice", "translation", "reading"]
#: Attempts of a block, by id, when the wrong ones of an entry are numbered.
ATTEMPTS_PER_BLOCK = 10_000


def wrong_history(graded: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, place, seen_at, student_answer, correct_answer``: one row for each wrong result that was saved, numbered
    in its entry from the earliest attempt on (by time, then id)."""
    wrong = lg.save_rule(graded).filter("saved_reason = 'wrong_answer'")
    day = F.floor(F.unix_timestamp(F.col("submitted_at").cast("timestamp")) / lg.BLOCK_SECONDS)
    numbered = running(wrong, keys, ["submitted_at", "attempt_id"], day, {"place": Running("sum", F.lit(1).cast("bigint"))})
    return numbered.select(*keys, "place", F.col("submitted_at").alias("seen_at"), "student_answer", F.col("answer_key").alias("correct_answer"))


def tag_counts(ledger: DataFrame) -> DataFrame:
    """``tag, entries``: an entry counts under each of its tags once. ``ledger``: tags (an array; null: none)."""
    tags = ledger.select(F.explode(F.array_distinct("tags")).alias("tag"))
    return tags.filter(F.coalesce("tag", F.lit("")) != "").groupBy("tag").agg(F.count(F.lit(1)).alias("entries"))


def sync_notes(ledger: DataFrame, notes: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """``ledger`` with the notes of a paper's submission: one under the question's id counts before one under its
    number. Where the trimmed note differs it is taken over, ``note_updated_at`` is ``at`` and ``updated`` true.

    ``ledger``: keys, question_id, number, note, note_updated_at, …; ``notes``: keys, name (an id or a number), note.
    A null note is an empty one; of several notes under one name the largest counts."""
    given = notes.groupBy(*keys, "name").agg(F.max(F.trim(F.coalesce("note", F.lit("")))).alias("given"))
    by_id = given.select(*keys, F.col("name").alias("question_id"), F.col("given").alias("by_id"))
    by_number = given.select(*keys, F.col("name").alias("number_name"), F.col("given").alias("by_number"))
    rows = ledger.withColumn("number_name", F.coalesce(F.col("number").cast("string"), F.lit("")))
    rows = rows.join(by_id, [*keys, "question_id"], "left").join(by_number, [*keys, "number_name"], "left")
    new = F.coalesce("by_id", F.when(F.col("number_name") != "", F.col("by_number")))
    updated = new.isNotNull() & ~new.eqNullSafe(F.col("note"))
    rows = rows.withColumns({"new": new, "updated": updated})
    rows = rows.withColumns({"note": F.when(F.col("updated"), F.col("new")).otherwise(F.col("note")), "note_updated_at": F.when(F.col("updated"), at).otherwise(F.col("note_updated_at"))})
    return rows.select(*ledger.columns, "updated")


def list_ledger(ledger: DataFrame, contexts: DataFrame, tag: str | None = None, status: str | None = None) -> DataFrame:
    """Entries with fresh ``exam_type``, ``context_key`` (of cloze and reading, else empty) and ``stem`` (a cloze's
    sentence around its blank, where there is one), of one tag and one status if given. Order them by
    ``last_seen_at`` descending. ``ledger``: entry_id, paper_id, question_id, number, section_title, type, stem,
    tags, status, last_seen_at; ``contexts``: paper_id, question_id, context_key, context_text."""
    rows = ledger
    if tag:
        rows = rows.filter(F.coalesce(F.array_contains("tags", tag), F.lit(False)))
    if status:
        rows = rows.filter(F.col("status") == status)
    placed = rows.join(contexts.select("paper_id", "question_id", F.col("context_key").alias("found_key"), "context_text"), ["paper_id", "question_id"], "left")
    placed = placed.withColumn("exam_type", lg.exam_type(F.col("type"), F.col("section_title")))
    key = F.when(F.col("exam_type").isin(*WITH_CONTEXT), F.coalesce("found_key", F.lit(""))).otherwise("")
    placed = placed.withColumn("context_key", key)
    blanks = placed.filter("exam_type = 'cloze' AND context_text IS NOT NULL").select(F.col("entry_id").alias("doc_id"), "number", F.col("context_text").alias("text"))
    found = cloze_sentence(blanks).select(F.col("doc_id").alias("entry_id"), "sentence")
    stem = F.coalesce(F.nullif(F.col("sentence"), F.lit("")), F.col("stem"))
    columns = [c for c in ledger.columns if c not in ("stem", "exam_type", "context_key")]
    return placed.join(found, "entry_id", "left").select(*columns, "exam_type", "context_key", stem.alias("stem"))


def ledger_contexts(listed: DataFrame, contexts: DataFrame) -> DataFrame:
    """``context_key, directions, passage`` once for each context that listed entries have. ``contexts``: context_key,
    directions, passage, with a row for each question or context."""
    used = listed.filter(F.col("exam_type").isin(*WITH_CONTEXT) & (F.col("context_key") != "")).select("context_key").distinct()
    once = contexts.join(used, "context_key", "left_semi").groupBy("context_key")
    return once.agg(F.max("directions").alias("directions"), F.max("passage").alias("passage"))


def ledger_search(listed: DataFrame, contexts: DataFrame, exam_type: str, status: str = "all", tag: str = "all", query: str = "") -> DataFrame:
    """Entries of one exam type that pass the filters, with ``paper_seen_at`` and ``number_value``: order them by
    learner_id, ``paper_seen_at`` descending, paper_id, ``number_value``, number. The tag ``noted`` asks for a note;
    ``query`` is looked for, whatever its case, in the entry's texts joined by blanks and its context's.

    ``listed``: learner_id, entry_id, paper_id, exam_type, status, tags, note, context_key, last_seen_at, number,
    section_title, stem; ``contexts``: context_key, directions, passage, once each."""
    rows = listed.filter(F.col("exam_type") == exam_type)
    if status != "all":
        rows = rows.filter(F.col("status") == status)
    if tag == "noted":
        rows = rows.filter(has_answer(F.col("note")))
    elif tag != "all":
        rows = rows.filter(F.coalesce(F.array_contains("tags", tag), F.lit(False)))
    if query:
        texts = rows.join(contexts, "context_key", "left")
        text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("section_title", "number", "stem", "note", "directions", "passage")])
        rows = texts.filter(F.contains(F.lower(text), F.lit(query.lower()))).select(*rows.columns)
    first = rows.groupBy("learner_id", "paper_id").agg(F.max("last_seen_at").alias("paper_seen_at"))
    return rows.join(first, ["learner_id", "paper_id"]).withColumn("number_value", F.col("number").cast("string").try_cast("bigint"))


def ledger_groups(listed: DataFrame, contexts: DataFrame) -> DataFrame:
    """``entry_id, group_key, size``: entries of one learner that share a context stand together, others alone."""
    there = contexts.select("context_key", F.lit(True).alias("there")).distinct()
    alone = F.concat(F.lit("missing:"), F.col("entry_id").cast("string"))
    keyed = listed.join(there, "context_key", "left").withColumn("group_key", F.when(F.col("there"), F.col("context_key")).otherwise(alone))
    sizes = keyed.groupBy("learner_id", "group_key").agg(F.count(F.lit(1)).alias("size"))
    return keyed.select("learner_id", "entry_id", "group_key").join(sizes, ["learner_id", "group_key"])


# Practice -------------------------------------------------------------------------------------


def submit_practice(entries: DataFrame, ledger: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, rejects) of submitted answers. A record that names an entry twice (``repeated``) or one that isn't
    in the ledger (``unknown``) is rejected as a whole. Blank answers are ``unanswered``; entries with options and
    a key are graded by the ledger's key; others take the scorer's verdict, and without one are ``pending``.

    ``entries``: record_id, entry_id, answer; ``ledger``: entry_id, has_options, correct_answer; ``verdicts``:
    record_id, entry_id, is_correct. Results: record_id, entry_id, answer, grading_status, is_correct,
    graded_by."""
    known = ledger.select("entry_id", "has_options", "correct_answer", F.lit(True).alias("known"))
    named = entries.groupBy("record_id", "entry_id").agg(F.count(F.lit(1)).alias("times"), F.max("answer").alias("answer")).join(known, "entry_id", "left")
    judged = named.groupBy("record_id").agg(F.max(F.col("times") > 1).alias("twice"), F.max(F.col("known").isNull()).alias("lost"))
    rejects = judged.filter("twice OR lost").select("record_id", F.when(F.col("twice"), "repeated").otherwise("unknown").alias("reason"))
    taken = named.join(rejects.select("record_id"), "record_id", "left_anti")
    scored = verdicts.groupBy("record_id", "entry_id").agg(F.max("is_correct").alias("verdict"))
    # Verdicts are about as many as entries: they are no table to hold in every task, however small it is written.
    rows = taken.join(scored.hint("merge"), ["record_id", "entry_id"], "left")
    answered, key = has_answer(F.col("answer")), normalize_answer(F.col("correct_answer"))
    by_key = F.coalesce("has_options", F.lit(False)) & has_answer(F.col("correct_answer"))
    by = F.when(~answered, "none").when(by_key, "key").otherwise("scorer")
    rows = rows.withColumn("graded_by", by)
    same = (F.size(key) > 0) & (key == normalize_answer(F.col("answer")))
    correct = F.when(F.col("graded_by") == "key", same).when(F.col("graded_by") == "scorer", F.col("verdict"))
    state = F.when(F.col("graded_by") == "none", "unanswered").when(correct.isNull(), "pending").otherwise("graded")
    return rows.select("record_id", "entry_id", "answer", state.alias("grading_status"), correct.alias("is_correct"), "graded_by"), rejects


def practice_output(results: DataFrame, ledger: DataFrame) -> DataFrame:
    """``results`` with ``previous_answer`` (the entry's last review, else its first answer) and ``correct_answer``.
    ``ledger``: entry_id, last_review_answer, student_answer, correct_answer."""
    own = ledger.select("entry_id", F.coalesce("last_review_answer", "student_answer").alias("previous_answer"), "correct_answer")
    return results.join(own, "entry_id", "left")


def practice_events(results: DataFrame) -> DataFrame:
    """``record_id, entry_id, kind, is_correct``: what a submission adds to the ledger's events; only verdicts do."""
    return results.filter("is_correct IS NOT NULL").select("record_id", "entry_id", F.lit("attempt").alias("kind"), "is_correct")


def practice_records(records: DataFrame, draft: DataFrame, attempts: DataFrame) -> DataFrame:
    """``record_id, exam_type, created_at, answered_count, correct_count, wrong_count, submission_count`` of records of the
    types that are shown. Order them by ``created_at`` descending. ``records``: record_id, exam_type, created_at;
    ``draft``: record_id, entry_id, answer, is_correct; ``attempts``: record_id, one row each."""
    shown = records.filter(F.col("exam_type").isin(*PRACTISED))
    filled = draft.groupBy("record_id").agg(F.count_if(F.coalesce("answer", F.lit("")) != "").alias("answered_count"), F.count_if("is_correct").alias("correct_count"), F.count_if(~F.col("is_correct")).alias("wrong_count"))
    sent = attempts.groupBy("record_id").agg(F.count(F.lit(1)).alias("submission_count"))
    joined = shown.join(filled, "record_id", "left").join(sent, "record_id", "left")
    counts = ["answered_count", "correct_count", "wrong_count", "submission_count"]
    return joined.select("record_id", "exam_type", "created_at", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def record_results(draft: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(draft, submissions): each entry's latest result, by ``seq``, lies over its draft; every batch of results is a
    submission. ``draft``: record_id, entry_id, answer, is_correct; ``results``: record_id, entry_id, seq, answer,
    is_correct. Submissions: record_id, seq, results."""
    last = results.groupBy("record_id", "entry_id").agg(F.max_by(F.struct("answer", "is_correct"), "seq").alias("r"))
    both = draft.join(last, ["record_id", "entry_id"], "full")
    over = lambda c: F.when(F.col("r").isNotNull(), F.col(f"r.{c}")).otherwise(F.col(c)).alias(c)
    rows = both.select("record_id", "entry_id", over("answer"), over("is_correct"), F.col("r").isNotNull().alias("revealed"))
    return rows, results.groupBy("record_id", "seq").agg(F.count(F.lit(1)).alias("results"))


def practice_progress(shown: DataFrame, results: DataFrame) -> DataFrame:
    """``record_id, entries, answered, correct, wrong, undecided`` of the entries that are shown. ``shown``: record_id,
    entry_id; ``results``: record_id, entry_id, answer, is_correct."""
    rows = shown.join(results.select("record_id", "entry_id", "answer", "is_correct"), ["record_id", "entry_id"], "left")
    return rows.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(has_answer(F.col("answer"))).alias("answered"), F.count_if("is_correct").alias("correct"),
        F.count_if(~F.col("is_correct")).alias("wrong"), F.count_if(F.col("is_correct").isNull()).alias("undecided"),
    )
