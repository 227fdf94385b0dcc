"""Mistakes ledger: which results are kept, and what is kept of them.

Everything is an aggregate per entry, so a rebuild from the whole attempt log combines map-side
before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.answers import has_answer
from ..functions.scans import Running, running

# Question types and title marks of each exam type, in the order they are tried.
CHOICE_TYPES = ["single_choice", "multiple_choice", "true_false"]
TRANSLATION_TYPES = ["translation", "short_answer"]
WRITING_TYPES = ["essay", "writing", "composition"]
CLOZE_TITLE = "cloze|完形|完型"
READING_TITLE = "reading|阅读"
TRANSLATION_TITLE = "translation|翻译|汉译英"
WRITING_TITLE = "writing|composition|作文"
DONE_STATUSES = ["reviewed", "mastered"]


def _titled(title: Column, marks: str) -> Column:
    return F.lower(F.coalesce(title, F.lit(""))).rlike(marks)


def is_translation(type_: Column, title: Column) -> Column:
    return F.coalesce(type_.isin(*TRANSLATION_TYPES), F.lit(False)) & _titled(title, TRANSLATION_TITLE)


def is_writing(type_: Column, title: Column) -> Column:
    return F.coalesce(type_.isin(*WRITING_TYPES), F.lit(False)) | _titled(title, WRITING_TITLE)


def exam_type(type_: Column, title: Column) -> Column:
    """The first of cloze, reading, writing and translation that fits; else choice."""
    choice = F.coalesce(type_.isin(*CHOICE_TYPES), F.lit(False))
    return (
        F.when(choice & _titled(title, CLOZE_TITLE), "cloze")
        .when(choice & _titled(title, READING_TITLE), "reading")
        .when(is_writing(type_, title), "writing")
        .when(is_translation(type_, title), "translation")
        .otherwise("choice")
    )


def save_rule(graded: DataFrame) -> DataFrame:
    """Results that enter the ledger, with ``saved_reason``.

    Translations always do. Others do when wrong or noted, unless their answer is blank and they
    are neither writing nor noted.
    """
    wrong = F.coalesce(~F.col("is_correct"), F.lit(False))
    noted = F.coalesce("note", F.lit("")) != ""
    translation = is_translation(F.col("type"), F.col("section_title"))
    answered = noted | is_writing(F.col("type"), F.col("section_title")) | has_answer(F.col("student_answer"))
    reason = F.when(wrong, "wrong_answer").when(translation, "translation_all").otherwise("question_note")
    return graded.filter(translation | ((wrong | noted) & answered)).withColumn("saved_reason", reason)


def ledger_build(graded: DataFrame, keys: list[str]) -> DataFrame:
    """One entry per key from all its saved results; the later attempt wins, ties by attempt id."""
    saved = save_rule(graded)
    when = F.struct("submitted_at", "attempt_id")
    wrong = F.coalesce(~F.col("is_correct"), F.lit(False))
    tagged = F.coalesce("tag", F.lit("")) != ""
    return saved.groupBy(*keys).agg(
        F.sum(wrong.cast("bigint")).alias("wrong_count"),
        F.min("submitted_at").alias("first_seen_at"),
        F.max("submitted_at").alias("last_seen_at"),
        F.max_by("student_answer", when).alias("student_answer"),
        F.max_by("answer_key", when).alias("correct_answer"),
        F.max_by("saved_reason", when).alias("saved_reason"),
        F.max_by("tag", F.when(tagged, when)).alias("category"),
        F.coalesce(F.max_by("note", F.when(F.col("note").isNotNull(), when)), F.lit("")).alias("note"),
        F.max(F.when(F.col("note").isNotNull(), F.col("submitted_at"))).alias("note_updated_at"),
    )


def facet_counts(ledger: DataFrame) -> DataFrame:
    """``facet, value, entries``: by exam type, by tag, and how many are still to be reviewed."""
    facets = F.array(
        F.struct(F.lit("type").alias("facet"), exam_type(F.col("type"), F.col("section_title")).alias("value")),
        F.struct(F.lit("tag").alias("facet"), F.col("category").alias("value")),
        F.struct(F.lit("pending").alias("facet"), F.when(~F.coalesce(F.col("status").isin(*DONE_STATUSES), F.lit(False)), F.lit("")).alias("value")),
    )
    return (
        ledger.select(F.explode(facets).alias("f")).select("f.*").filter(F.col("value").isNotNull())
        .groupBy("facet", "value").agg(F.count("*").alias("entries"))
    )


# Review events --------------------------------------------------------------------------------

#: Seconds of a block of events; a busy entry is scanned in as many tasks as it has blocks.
BLOCK_SECONDS = 86_400
_AT = ["ts", "event_id"]


def _block() -> Column:
    return F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / BLOCK_SECONDS)


def live_events(events: DataFrame) -> DataFrame:
    """The events that an entry still remembers: those after its last delete, from the first wrong
    grading on, as an entry exists from there. ``events``: event_id, ts, entry_id, kind, is_correct,
    patch_status; order is by ``ts`` and then ``event_id``."""
    at = F.struct(*_AT)
    deleted = events.groupBy("entry_id").agg(F.max(F.when(F.col("kind") == "delete", at)).alias("deleted"))
    later = events.join(deleted, "entry_id").filter(F.col("deleted").isNull() | (at > F.col("deleted"))).drop("deleted")
    opened = later.groupBy("entry_id").agg(F.min(F.when(F.col("kind") == "graded_wrong", at)).alias("opened"))
    return later.join(opened.filter("opened IS NOT NULL"), "entry_id").filter(at >= F.col("opened")).drop("opened")


def _hard_status() -> Column:
    """The status that an event sets whatever the status before; null for notes and marks."""
    kind = F.col("kind")
    return (
        F.when(kind == "graded_wrong", "unreviewed")
        .when(kind == "attempt", F.when(F.coalesce("is_correct", F.lit(False)), "mastered").otherwise("unreviewed"))
        .when(kind == "patch", F.col("patch_status"))
    )


def ledger_status(events: DataFrame) -> DataFrame:
    """``entry_id, status, wrong_count`` of every entry that exists after all events.

    A mark never changes whether an entry is mastered, so the status follows from the last event that
    sets one and from whether a mark comes after it: two aggregates, without a scan.
    """
    at = F.struct(*_AT)
    rows = live_events(events).withColumn("hard", _hard_status())
    last = rows.groupBy("entry_id").agg(
        F.max_by("hard", F.when(F.col("hard").isNotNull(), at)).alias("hard"),
        F.max(F.when(F.col("hard").isNotNull(), at)).alias("set_at"),
        F.max(F.when(F.col("kind") == "mark_reviewed", at)).alias("marked_at"),
        F.count_if(F.col("kind") == "graded_wrong").alias("wrong_count"),
    )
    marked = F.coalesce(F.col("marked_at") > F.col("set_at"), F.lit(False)) & (F.col("hard") != "mastered")
    return last.select("entry_id", F.when(marked, "reviewed").otherwise(F.col("hard")).alias("status"), "wrong_count")


def reviews(events: DataFrame) -> DataFrame:
    """The events that count as a review, with their number ``review`` in the entry: attempts, and marks
    of an entry that is not mastered at that time."""
    hard = running(live_events(events), ["entry_id"], _AT, _block(), {"status": Running("last", _hard_status(), inclusive=False)})
    counted = hard.filter((F.col("kind") == "attempt") | ((F.col("kind") == "mark_reviewed") & (F.col("status") != "mastered")))
    return running(counted, ["entry_id"], _AT, _block(), {"review": Running("sum", F.lit(1).cast("bigint"))})


def review_counters(events: DataFrame) -> DataFrame:
    """``entry_id, review_count, correct_review_count, last_review_correct, reviewed_at`` of every entry
    that was reviewed."""
    tried = F.when(F.col("kind") == "attempt", F.struct(*_AT))
    return reviews(events).groupBy("entry_id").agg(
        F.count(F.lit(1)).alias("review_count"),
        F.count_if(F.coalesce((F.col("kind") == "attempt") & F.col("is_correct"), F.lit(False))).alias("correct_review_count"),
        F.max_by(F.coalesce("is_correct", F.lit(False)), tried).alias("last_review_correct"),
        F.max("ts").alias("reviewed_at"),
    )


def review_history(events: DataFrame) -> DataFrame:
    """``entry_id, attempt, is_correct, reviewed_at``: one row an attempt, numbered in its entry."""
    tried = live_events(events).filter(F.col("kind") == "attempt")
    numbered = running(tried, ["entry_id"], _AT, _block(), {"attempt": Running("sum", F.lit(1).cast("bigint"))})
    return numbered.select("entry_id", "attempt", F.coalesce("is_correct", F.lit(False)).alias("is_correct"), F.col("ts").alias("reviewed_at"))


# The statuses and the tags that an entry may have.
STATUSES = ["unreviewed", "reviewed", "mastered"]
TAGS = ["grammar", "vocabulary", "phrase", "translation"]


def apply_changes(ledger: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger, rejects) after a batch of changes in order of ``seq``.

    ``ledger``: entry_id, status, note, tags; ``changes``: seq, entry_id, note, tags, status, deleted. A
    null leaves the value as it is. Notes are trimmed, tags lose repeats and keep their order. A change
    with an unknown status or tag, of an entry that isn't there, or after the entry's deletion is rejected
    with its ``reason`` and changes nothing.
    """
    status = F.col("status")
    bad = F.when(status.isNotNull() & ~status.isin(*STATUSES), "status").when(F.size(F.filter("tags", lambda t: ~F.coalesce(t.isin(*TAGS), F.lit(False)))) > 0, "tag")
    checked = changes.withColumn("bad", bad).join(ledger.select("entry_id", F.lit(True).alias("known")), "entry_id", "left")
    gone = checked.filter("known AND bad IS NULL AND deleted").groupBy("entry_id").agg(F.min("seq").alias("gone_at"))
    placed = checked.join(gone, "entry_id", "left")
    reason = F.when(F.col("known").isNull() | (F.col("seq") > F.col("gone_at")), "entry").otherwise(F.col("bad"))
    judged = placed.withColumn("reason", reason)
    rejects = judged.filter("reason IS NOT NULL").select("seq", "entry_id", "reason")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}")
    applied = judged.filter("reason IS NULL").groupBy("entry_id").agg(last("note"), last("tags"), last("status"), F.max("gone_at").alias("gone_at"))
    joined = ledger.join(applied, "entry_id", "left").filter("gone_at IS NULL")
    return joined.select(
        "entry_id", F.coalesce("new_status", "status").alias("status"), F.coalesce(F.trim("new_note"), "note").alias("note"), F.coalesce(F.array_distinct("new_tags"), "tags").alias("tags")
    ), rejects
