"""Submissions of learners: the latest record, kept attempts, highlights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.answers import has_answer
from ..functions.scans import Running, running

SALTS = 32
POSITIONS_PER_BLOCK = 4096


def latest_record(records: DataFrame, keys: list[str]) -> DataFrame:
    """The newest record of each key; of equally new ones the one that is no legacy file."""
    newest = F.struct("mtime", (~F.col("is_legacy")).alias("current"), "record_id")
    return records.groupBy(*keys).agg(F.max(newest).alias("n")).select(*keys, "n.record_id", "n.mtime")


def keep_last_attempts(attempts: DataFrame, keys: list[str], keep: int = 30) -> DataFrame:
    """The latest ``keep`` attempts of each key, by time and then id.

    Each part of a key drops what its own later attempts push out, so a popular key is not
    sorted in one task.
    """
    order = [F.col("mtime").desc(), F.col("record_id").desc()]
    rows = attempts.withColumn("__part", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)))
    for parts in (["__part"], []):
        rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys, *parts).orderBy(*order))).filter(F.col("__rank") <= keep)
    return rows.drop("__part", "__rank")


def merge_highlights(ranges: DataFrame, key: str = "element") -> DataFrame:
    """Valid ranges of each text, with those that overlap or touch made one.

    Equal ranges count once: two scans would order them in two ways, and one that opens nothing must not
    come before the one that does."""
    valid = ranges.filter("start_pos >= 0 AND end_pos <= text_len AND end_pos > start_pos").select(key, "start_pos", "end_pos").distinct()
    block = F.floor(F.col("start_pos") / POSITIONS_PER_BLOCK)
    order = ["start_pos", "end_pos"]
    reached = running(valid, [key], order, block, {"reached": Running("max", F.col("end_pos"), inclusive=False)})
    opens = (F.col("reached").isNull() | (F.col("start_pos") > F.col("reached"))).cast("int")
    marked = reached.withColumn("opens", opens).drop("reached")
    islands = running(marked, [key], order, block, {"island": Running("sum", F.col("opens"))})
    return islands.groupBy(key, "island").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("island")


def draft_upsert(drafts: DataFrame, keys: list[str]) -> DataFrame:
    """The latest draft of each key, by time and then id: null notes keep the last ones that were given, and
    a duration is 0 or more. ``drafts``: keys, mtime, record_id, notes, duration_seconds."""
    at = F.struct("mtime", "record_id")
    last = drafts.groupBy(*keys).agg(F.max_by(F.struct("record_id", "duration_seconds"), at).alias("d"), F.max_by("notes", F.when(F.col("notes").isNotNull(), at)).alias("notes"))
    duration = F.greatest(F.lit(0), F.coalesce("d.duration_seconds", F.lit(0))).cast("bigint")
    return last.select(*keys, "d.record_id", "notes", duration.alias("duration_seconds"))


def delete_records(records: DataFrame, deletions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records that stay, rejects): a deletion of a record that isn't there is rejected; the first deletion
    of a record counts, by ``seq``. ``deletions``: keys, seq."""
    first = deletions.groupBy(*keys).agg(F.min("seq").alias("first"))
    known = records.select(*keys, F.lit(True).alias("known")).distinct()
    judged = deletions.join(first, keys).join(known, keys, "left")
    rejects = judged.filter(F.col("known").isNull() | (F.col("seq") > F.col("first"))).select(*keys, "seq")
    return records.join(first.select(*keys), keys, "left_anti"), rejects


def record_history(records: DataFrame, answers: DataFrame, attempts: DataFrame) -> DataFrame:
    """``record_id, paper_id, answered_count, attempt_count, last_score, status, updated_at`` of every record. A record
    with answers, if only blank ones, is ``in_progress`` until it is submitted. ``updated_at`` is the draft's time,
    else the last attempt's, else the file's. Order them by it, descending.

    ``records``: record_id, paper_id, draft_at, mtime; ``answers``: record_id, question_id, answer; ``attempts``:
    record_id, seq, submitted_at, total_score; the last attempt is that of the largest seq, time and score."""
    filled = answers.groupBy("record_id").agg(F.count(F.lit(1)).alias("named"), F.count_if(has_answer(F.col("answer"))).alias("answered_count"))
    sent = attempts.groupBy("record_id").agg(F.count(F.lit(1)).alias("attempt_count"), F.max(F.struct("seq", "submitted_at", "total_score")).alias("last"))
    rows = records.join(filled, "record_id", "left").join(sent, "record_id", "left")
    status = F.when(F.col("attempt_count") > 0, "submitted").when(F.col("named") > 0, "in_progress").otherwise("new")
    return rows.select(
        "record_id", "paper_id", F.coalesce("answered_count", F.lit(0)).alias("answered_count"), F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"),
        F.col("last.total_score").alias("last_score"), status.alias("status"), F.coalesce("draft_at", "last.submitted_at", "mtime").alias("updated_at"),
    )


def reconcile_drafts(server: DataFrame, backup: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, source, saved_at, draft``: the backup where its time can be read and is later than the server's, or
    the server's can't be read or is missing; else the server's, else none. Times are texts, one draft a key."""
    ours = server.select(*keys, F.col("saved_at").alias("server_at"), F.col("draft").alias("server_draft"), F.lit(True).alias("held"))
    theirs = backup.select(*keys, F.col("saved_at").alias("local_at"), F.col("draft").alias("local_draft"))
    read = lambda c: F.try_to_timestamp(F.col(c))
    newer = read("local_at").isNotNull() & (read("server_at").isNull() | (read("local_at") > read("server_at")))
    both = ours.join(theirs, keys, "full").withColumn("newer", F.coalesce(newer, F.lit(False)))
    kept = both.filter("newer OR held")
    pick = lambda a, b: F.when(F.col("newer"), F.col(a)).otherwise(F.col(b))
    return kept.select(*keys, F.when(F.col("newer"), "backup").otherwise("server").alias("source"), pick("local_at", "server_at").alias("saved_at"), pick("local_draft", "server_draft").alias("draft"))
