"""Deleting, restoring and purging against a plain fold over requests and entries."""

import datetime as dt
import random

import pytest

from paperloom.operators import jobs as jb, library as lb, trash as tr

DAY = dt.datetime(2024, 1, 1)
ITEMS = "item_id string, kind string, parent_id string, superseded boolean"


def fold(requests, items, hidden, busy):
    """One request after the other, on the state that the ones before left."""
    by_id, hidden, rows, rejects = {i[0]: i for i in items}, set(hidden), [], []
    for seq, item, at in sorted(requests):
        if item in hidden:
            rejects.append((seq, item, "hidden"))
            continue
        if item not in by_id:
            rejects.append((seq, item, "missing"))
            continue
        if by_id[item][3]:
            rejects.append((seq, item, "superseded"))
            continue
        ids = [item] + [i[0] for i in items if by_id[item][1] == "collection" and i[2] == item and i[0] not in hidden]
        if set(ids) & set(busy):
            rejects.append((seq, item, "busy"))
            continue
        rows += [(seq, item, i, at, at + dt.timedelta(days=15)) for i in ids]
        hidden |= set(ids)
    return sorted(rows), sorted(rejects)


@pytest.mark.parametrize("seed", range(4))
def test_closure_is_the_fold(spark, seed):
    rng = random.Random(seed)
    items = [(f"c{i}", "collection", None, rng.random() < 0.1) for i in range(12)] + [(f"p{i}", "paper", f"c{i // 4}", rng.random() < 0.1) for i in range(48)]
    ids = [i[0] for i in items] + ["gone", "lost"]
    requests = [(n, rng.choice(ids[:12]) if rng.random() < 0.3 else rng.choice(ids), DAY + dt.timedelta(hours=n)) for n in range(70)]
    hidden, busy = [*rng.sample(ids[:60], 6), "gone"], rng.sample(ids[:60], 5)
    rows, rejects = tr.trash_closure(
        spark.createDataFrame(requests, "seq long, item_id string, asked_at timestamp_ntz"), spark.createDataFrame(items, ITEMS),
        spark.createDataFrame([(h,) for h in hidden], "item_id string"), spark.createDataFrame([(b,) for b in busy], "item_id string"))
    got = sorted(tuple(r) for r in rows.select("entry_id", "root_id", "item_id", "deleted_at", "expires_at").collect())
    assert (got, sorted(tuple(r) for r in rejects.collect())) == fold(requests, items, hidden, busy)


def test_a_source_stays_while_one_of_two_entries_can_be_restored(spark):
    items = spark.createDataFrame([("c1", "collection", None, False), ("p1", "paper", "c1", False), ("p2", "paper", "c1", False)], ITEMS)
    days = lambda n: DAY + dt.timedelta(days=n)
    entries = spark.createDataFrame([(1, "p1", days(0), days(15), False), (2, "p2", days(5), days(20), False)], "entry_id long, item_id string, deleted_at timestamp_ntz, expires_at timestamp_ntz, purged boolean")
    jobs = spark.createDataFrame([(1, "u1"), (2, "u1"), (3, "u2")], "job_id long, upload string")
    results = spark.createDataFrame([(1, "p1"), (2, "p1"), (2, "p2")], "job_id long, item_id string")
    left = lambda at: sorted(tuple(r) for r in tr.purge_orphans(entries, items, jobs, results, at).collect())
    # Job 2 and its upload wait for the second paper, as does the source; job 3 has no results.
    assert left("2024-01-17 00:00:00") == [("job", "1")]
    assert left("2024-01-22 00:00:00") == [("job", "1"), ("job", "2"), ("source", "c1"), ("upload", "u1")]
    none = spark.createDataFrame([], "item_id string")
    plan = tr.purge_plan(entries, items, none, spark.createDataFrame([(9, "p1")], "record_id long, item_id string"), "2024-01-16 00:00:00")
    assert sorted(tuple(r) for r in plan.collect()) == [("link", "c1/p1"), ("paper", "p1"), ("submission", "9"), ("tombstone", "1")]
    shown = tr.list_trash(entries, "2024-01-15 00:00:01").collect()
    assert sorted((r.entry_id, r.days_left) for r in shown) == [(1, 1), (2, 6)]
    assert tr.list_trash(entries, "2024-01-16 00:00:00").count() == 1  # due is no longer shown


def test_twenty_newest_first_then_hidden_ones_go(spark):
    jobs = spark.createDataFrame([(n, DAY + dt.timedelta(hours=n)) for n in range(25)], "job_id long, updated_at timestamp_ntz")
    results = spark.createDataFrame([(n, f"p{n}") for n in range(0, 25, 2)], "job_id long, item_id string")
    hidden = spark.createDataFrame([("p24",), ("p20",), ("p10",), ("p2",)], "item_id string")
    kept = sorted(r.job_id for r in jb.recent_jobs(jobs, results, hidden).collect())
    assert kept == [n for n in range(5, 25) if n not in (24, 20, 10)] and len(kept) == 17


def test_shelves_names(spark):
    custom = spark.createDataFrame([(1, "past", "Old exams"), (1, "shelf-1", "Mine")], "owner long, shelf_id string, name string")
    asked = [(1, 1, " mine "), (1, 2, "历年真题"), (1, 3, "New"), (1, 4, "NEW"), (1, 5, " "), (1, 6, None), (1, 7, "y" * 30), (1, 8, "y" * 31), (2, 9, "历年真题")]
    held, rejects = lb.shelves(custom, spark.createDataFrame(asked, "owner long, seq long, name string"))
    names = {(r.owner, r.shelf_id): r.name for r in held.collect()}
    # The renamed default shelf frees its old name.
    assert names[1, "past"] == "Old exams" and names[1, "shelf-2"] == "历年真题" and names[1, "shelf-3"] == "New" and names[2, "past"] == "历年真题"
    assert sorted(tuple(r) for r in rejects.collect()) == [(1, 1, "taken"), (1, 4, "taken"), (1, 5, "name"), (1, 6, "name"), (1, 8, "name"), (2, 9, "taken")]


def test_repair_keeps_chunks_only_where_every_issue_has_a_page(spark):
    chunks = spark.createDataFrame([(p, c, c + d) for p in (1, 2, 3) for c in (1, 2, 3) for d in (0, 1)], "paper_id long, chunk long, page long")
    issues = spark.createDataFrame([(1, "missing_stem", 2), (1, "no_source", None), (2, "missing_stem", 2), (2, "total_score", None)], "paper_id long, code string, page long")
    kept = sorted((r.paper_id, r.chunk) for r in jb.repair_plan(chunks, issues).collect() if r.reused)
    assert kept == [(1, 3)]
