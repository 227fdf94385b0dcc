"""Recoverable deletion: what an entry of the trash hides, when it goes for good, and what goes with it.

Entries are rows (entry, item), so a collection with many papers is many rows and never one list. All
rules are equality joins on items, entries, jobs and files.

``items``: item_id, kind ('paper' or 'collection'), parent_id (a paper's collection), superseded.
``entries``: entry_id, item_id, deleted_at, expires_at, purged; one row for each item of an entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Days for which an entry can be restored.
RETENTION_DAYS = 15


def hidden_ids(entries: DataFrame) -> DataFrame:
    """``item_id`` of everything in the trash; what is purged stays hidden."""
    return entries.select("item_id").distinct()


def trash_closure(requests: DataFrame, items: DataFrame, hidden: DataFrame, busy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) of a batch of requests in order of ``seq``.

    ``requests``: seq, item_id, asked_at; ``hidden``: item_id, before the batch; ``busy``: item_id that running
    jobs read or repair. Entries: entry_id (the request's seq), root_id, item_id, deleted_at, expires_at.
    A collection takes along those of its papers that aren't hidden yet. A request is rejected, with its
    first ``reason``, when its item is ``hidden`` by then, ``missing``, ``superseded``, or ``busy``; a
    collection is also busy with any paper it would take along.

    A busy paper can't be hidden by a request of its own, so whether a collection is busy doesn't depend
    on the order, and the first request of an item decides: no request needs the state after another.
    """
    known = hidden.select("item_id", F.lit(True).alias("was_hidden")).distinct()
    working = busy.select("item_id", F.lit(True).alias("in_work")).distinct()
    marked = items.join(known, "item_id", "left").join(working, "item_id", "left").select("item_id", "kind", "parent_id", F.coalesce("superseded", F.lit(False)).alias("superseded"), F.coalesce("was_hidden", F.lit(False)).alias("was_hidden"), F.coalesce("in_work", F.lit(False)).alias("in_work"))
    held_up = marked.filter("kind = 'paper' AND in_work AND NOT was_hidden").select(F.col("parent_id").alias("item_id"), F.lit(True).alias("child_busy")).distinct()
    judged = marked.join(held_up, "item_id", "left")
    static = F.when(F.col("was_hidden"), "hidden").when(F.col("superseded"), "superseded").when(F.col("in_work") | F.coalesce("child_busy", F.lit(False)), "busy")
    judged = judged.select("item_id", "kind", "parent_id", "was_hidden", static.alias("static"))
    first = requests.groupBy("item_id").agg(F.min("seq").alias("first_seq"))
    first = judged.join(first, "item_id", "left")
    taken = first.filter("kind = 'collection' AND static IS NULL AND first_seq IS NOT NULL").select(F.col("item_id").alias("parent_id"), F.col("first_seq").alias("parent_seq"))
    placed = first.join(taken, "parent_id", "left")
    # A paper goes by its own request if that comes before its collection's.
    own = F.when(F.col("static").isNull() & (F.col("parent_seq").isNull() | (F.col("first_seq") < F.col("parent_seq"))), F.col("first_seq"))
    placed = placed.select("item_id", "kind", "parent_id", "was_hidden", "static", "parent_seq", own.alias("own_seq"))
    told = requests.join(placed.drop("was_hidden"), "item_id", "left").join(known, "item_id", "left")
    reason = (
        F.when(F.col("kind").isNull(), F.when(F.col("was_hidden"), "hidden").otherwise("missing"))
        .when(F.col("seq") == F.col("own_seq"), F.lit(None).cast("string"))
        .when(F.least("own_seq", "parent_seq") < F.col("seq"), "hidden")
        .otherwise(F.col("static"))
    )
    told = told.withColumn("reason", reason)
    roots = told.filter("reason IS NULL").select(F.col("seq").alias("entry_id"), F.col("item_id").alias("root_id"), "kind", F.col("asked_at").alias("deleted_at"))
    children = placed.filter("kind = 'paper' AND NOT was_hidden AND own_seq IS NULL").select(F.col("parent_id").alias("root_id"), "item_id", F.col("parent_seq").alias("entry_id"))
    along = children.join(roots.filter("kind = 'collection'").select("entry_id", "root_id", "deleted_at"), ["entry_id", "root_id"])
    rows = roots.select("entry_id", "root_id", F.col("root_id").alias("item_id"), "deleted_at").unionByName(along.select("entry_id", "root_id", "item_id", "deleted_at"))
    rows = rows.withColumn("expires_at", F.col("deleted_at") + F.expr(f"INTERVAL {RETENTION_DAYS} DAYS"))
    return rows, told.filter("reason IS NOT NULL").select("seq", "item_id", "reason")


def _due(at: str) -> Column:
    return ~F.col("purged") & (F.col("expires_at") <= F.lit(at).cast("timestamp_ntz"))


def restore_check(entries: DataFrame, items: DataFrame, at: str) -> DataFrame:
    """``entry_id, reason``: why an entry can't be restored at ``at``; null where it can. ``expired`` comes
    before ``missing`` (an item's file is gone), that before ``parent`` (an item's collection is hidden by
    another entry)."""
    rows = entries.join(items.select("item_id", "parent_id", F.lit(True).alias("there")), "item_id", "left")
    # How many entries hide a collection, and whether this one does: no pairs of entries are made.
    hides = entries.select("entry_id", F.col("item_id").alias("parent_id")).distinct()
    count = hides.groupBy("parent_id").agg(F.count(F.lit(1)).alias("hiding"))
    rows = rows.join(count, "parent_id", "left").join(hides.withColumn("itself", F.lit(1)), ["entry_id", "parent_id"], "left")
    others = F.coalesce("hiding", F.lit(0)) - F.coalesce("itself", F.lit(0))
    late = F.col("purged") | (F.col("expires_at") <= F.lit(at).cast("timestamp_ntz"))
    found = rows.groupBy("entry_id").agg(F.max(late).alias("late"), F.max(F.col("there").isNull()).alias("missing"), F.max(others > 0).alias("under"))
    return found.select("entry_id", F.when(F.col("late"), "expired").when(F.col("missing"), "missing").when(F.col("under"), "parent").alias("reason"))


def list_trash(entries: DataFrame, at: str) -> DataFrame:
    """``entry_id, deleted_at, items, days_left`` of entries that can still be seen at ``at``: not purged and
    not due. Days are rounded up. Order them by ``deleted_at`` descending to show them."""
    left = entries.filter(~F.col("purged") & ~_due(at)).groupBy("entry_id").agg(F.max("deleted_at").alias("deleted_at"), F.max("expires_at").alias("expires_at"), F.count(F.lit(1)).alias("items"))
    micros = F.unix_micros(F.col("expires_at").cast("timestamp")) - F.unix_micros(F.lit(at).cast("timestamp"))
    days = F.greatest(F.lit(0), F.ceil(micros / 86_400_000_000)).cast("bigint")
    return left.select("entry_id", "deleted_at", "items", days.alias("days_left"))


def purge_plan(entries: DataFrame, items: DataFrame, overrides: DataFrame, submissions: DataFrame, at: str) -> DataFrame:
    """``target, key``: what goes at ``at``. Targets: ``paper`` (an item), ``override`` (an item with its own
    category or title), ``submission`` (a record of a paper), ``link`` (a paper in a collection that stays)
    and ``tombstone`` (the entry, which is kept without content). ``overrides``: item_id; ``submissions``:
    record_id, item_id."""
    due = entries.filter(_due(at))
    going = due.select("item_id").distinct()
    there = items.join(going, "item_id", "left_semi")
    away = entries.filter(F.col("purged") | _due(at)).select(F.col("item_id").alias("parent_id")).distinct()
    stays = items.filter("kind = 'collection'").select(F.col("item_id").alias("parent_id")).join(away, "parent_id", "left_anti")
    links = there.filter("kind = 'paper'").join(stays, "parent_id", "left_semi")
    row = lambda df, target, key: df.select(F.lit(target).alias("target"), key.cast("string").alias("key"))
    parts = [
        row(there, "paper", F.col("item_id")),
        row(overrides.join(going, "item_id", "left_semi"), "override", F.col("item_id")),
        row(submissions.join(going, "item_id", "left_semi"), "submission", F.col("record_id")),
        row(links, "link", F.concat_ws("/", "parent_id", "item_id")),
        row(due.select("entry_id").distinct(), "tombstone", F.col("entry_id")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def purge_orphans(entries: DataFrame, items: DataFrame, jobs: DataFrame, results: DataFrame, at: str) -> DataFrame:
    """``target, key``: what nothing refers to after the purge of ``at``.

    ``jobs``: job_id, upload; ``results``: job_id, item_id. A ``job`` goes when it has results and all of
    them are purged, an ``upload`` when a job of it goes and none that stays has it, a ``source`` (pages and
    images of a collection) when a purged item came from it and no item that is left does.
    """
    due = entries.filter(_due(at)).select("item_id").distinct()
    purged = entries.filter(F.col("purged") | _due(at)).select("item_id").distinct()
    flagged = results.join(purged.withColumn("purged", F.lit(True)), "item_id", "left")
    over = flagged.groupBy("job_id").agg(F.min(F.coalesce("purged", F.lit(False))).alias("over")).filter("over").select("job_id", "over")
    files = jobs.join(over, "job_id", "left").withColumn("over", F.coalesce("over", F.lit(False)))
    uploads = files.filter("upload IS NOT NULL").groupBy("upload").agg(F.min("over").alias("free")).filter("free")
    source = F.when(F.col("kind") == "collection", F.col("item_id")).otherwise(F.col("parent_id"))
    sourced = items.withColumn("source", source).filter("source IS NOT NULL")
    came = sourced.join(due, "item_id", "left_semi").select("source").distinct()
    # A collection without papers keeps no source; one with papers is kept by these.
    kept = sourced.filter("kind = 'paper'").join(purged, "item_id", "left_anti").select("source").distinct()
    free = came.join(kept, "source", "left_anti")
    row = lambda df, target, key: df.select(F.lit(target).alias("target"), F.col(key).cast("string").alias("key"))
    return row(files.filter("over"), "job", "job_id").unionByName(row(uploads, "upload", "upload")).unionByName(row(free, "source", "source"))
