"""Ledger events and plan actions against plain folds, one event after the other."""

import datetime as dt
import random

from paperloom.operators import ledger as lg, plans as pl

START = dt.datetime(2024, 1, 1, 22)


def ledger_fold(events):
    entries = {}
    for _, ts, entry, kind, correct, patch in sorted(events, key=lambda e: (e[1], e[0])):
        if kind == "delete":
            entries.pop(entry, None)
            continue
        if kind == "graded_wrong":
            e = entries.setdefault(entry, {"wrong": 0, "reviews": [], "correct": 0, "last": None, "at": None, "tries": []})
            e["status"], e["wrong"] = "unreviewed", e["wrong"] + 1
            continue
        if (e := entries.get(entry)) is None:
            continue
        if kind == "attempt":
            e["status"] = "mastered" if correct else "unreviewed"
            e["reviews"].append(ts)
            e["correct"] += bool(correct)
            e["last"], e["at"] = bool(correct), ts
            e["tries"].append((bool(correct), ts))
        elif kind == "mark_reviewed" and e["status"] != "mastered":
            e["status"], e["at"] = "reviewed", ts
            e["reviews"].append(ts)
        elif kind == "patch":
            e["status"] = patch
    return entries


def test_review_events_match_a_fold(spark):
    rng = random.Random(4)
    kinds = ["graded_wrong", "attempt", "mark_reviewed", "patch", "note"]
    events = []
    for i in range(1500):
        entry = "hot" if i % 3 == 0 else f"e{rng.randrange(40)}"
        kind = "delete" if rng.random() < 0.02 else rng.choice(kinds)
        events.append((i, START + dt.timedelta(hours=rng.randrange(900)), entry, kind, rng.choice([True, False, None]), rng.choice(lg.STATUSES)))
    rows = spark.createDataFrame(events, "event_id long, ts timestamp_ntz, entry_id string, kind string, is_correct boolean, patch_status string").repartition(3)
    want = ledger_fold(events)
    got = {r["entry_id"]: (r["status"], r["wrong_count"]) for r in lg.ledger_status(rows).collect()}
    assert got == {k: (e["status"], e["wrong"]) for k, e in want.items()}
    got = {r["entry_id"]: (r["review_count"], r["correct_review_count"], r["last_review_correct"], r["reviewed_at"]) for r in lg.review_counters(rows).collect()}
    assert got == {k: (len(e["reviews"]), e["correct"], e["last"], e["at"]) for k, e in want.items() if e["reviews"]}
    history = {}
    for r in sorted(lg.review_history(rows).collect(), key=lambda r: r["attempt"]):
        history.setdefault(r["entry_id"], []).append((r["is_correct"], r["reviewed_at"]))
    assert history == {k: e["tries"] for k, e in want.items() if e["tries"]}
    assert lg.ledger_status(rows.limit(0)).count() == 0 and lg.review_counters(rows.limit(0)).count() == 0


def test_changes_match_a_fold(spark):
    rng = random.Random(8)
    ledger = [(f"e{i}", "unreviewed", "old", ["grammar"]) for i in range(12)] + [("none", None, None, None)]
    changes = []
    for i in range(200):
        tags = rng.choice([None, [], ["phrase", "grammar", "phrase"], ["phrase", "spelling"], ["x"], ["translation", None]])
        changes.append((i, f"e{rng.randrange(15)}", rng.choice([None, "  n ", ""]), tags, rng.choice([None, "mastered", "reviewed", "lost"]), rng.random() < 0.03))
    state, rejects = {k: [s, n, t] for k, s, n, t in ledger}, []
    known, gone = set(state), set()
    for seq, entry, note, tags, status, deleted in changes:
        if entry not in known or entry in gone:
            rejects.append((seq, entry, "entry"))
        elif status is not None and status not in lg.STATUSES:
            rejects.append((seq, entry, "status"))
        elif tags is not None and any(t not in lg.TAGS for t in tags):
            rejects.append((seq, entry, "tag"))
        elif deleted:
            gone.add(entry)
        else:
            e = state[entry]
            e[0], e[1], e[2] = status or e[0], e[1] if note is None else note.strip(), e[2] if tags is None else list(dict.fromkeys(tags))
    kept, bad = lg.apply_changes(
        spark.createDataFrame(ledger, "entry_id string, status string, note string, tags array<string>"),
        spark.createDataFrame(changes, "seq long, entry_id string, note string, tags array<string>, status string, deleted boolean"),
    )
    assert sorted((tuple(r) for r in bad.collect())) == sorted(rejects)
    assert {r["entry_id"]: [r["status"], r["note"], r["tags"]] for r in kept.collect()} == {k: v for k, v in state.items() if k not in gone}


def plan_fold(actions, as_of):
    tasks, paused = {}, {}

    def settle(t, now):
        if t["since"] is not None:
            t["seconds"] += max(0, int((now - t["since"]).total_seconds()))
            t["since"] = None

    for _, ts, learner, day, task, action in sorted(actions, key=lambda a: (a[1], a[0])):
        plan = (learner, day)
        if action in ("plan_pause", "plan_resume"):
            if action == "plan_pause":
                for key, t in tasks.items():
                    if key[:2] == plan and t["status"] == "active":
                        settle(t, ts)
                        t["status"] = "paused"
            paused[plan] = action == "plan_pause"
            continue
        if action in ("start", "resume") and paused.get(plan):
            continue
        if action not in ("start", "resume", *pl.SETTLES):
            continue
        t = tasks.setdefault((*plan, task), {"seconds": 0, "since": None, "status": "pending", "done": None, "carried": None, "ran": False})
        if action in ("start", "resume"):
            for key, other in tasks.items():
                if key[:2] == plan and other is not t and other["status"] == "active":
                    settle(other, ts)
                    other["status"] = "paused"
            t["status"], t["since"], t["ran"] = "active", t["since"] or ts, True
            continue
        settle(t, ts)
        t["status"] = pl.SETTLES[action]
        if action == "complete":
            t["done"] = ts
        elif action == "reset":
            t["done"] = None
        elif action == "carryover":
            t["carried"] = day + dt.timedelta(days=1)
    for t in tasks.values():
        settle(t, as_of)
    return tasks


def test_plan_actions_match_a_fold(spark):
    rng = random.Random(6)
    names = ["start", "start", "resume", "pause", "complete", "skip", "reset", "carryover", "plan_pause", "plan_resume", "plan_resume", "unknown"]
    actions = []
    for i in range(1500):
        learner = 1 if i % 3 == 0 else rng.randrange(2, 12)
        ts = dt.datetime(2024, 1, rng.randrange(1, 4), rng.randrange(24), rng.randrange(60), rng.randrange(60), rng.randrange(10**6))
        actions.append((i, ts, learner, ts.date(), rng.randrange(4), rng.choice(names)))
    actions += [(5000 + i, actions[0][1], actions[0][2], actions[0][3], i % 2, "start") for i in range(4)]  # at the same time
    rows = spark.createDataFrame(actions, "event_id long, ts timestamp_ntz, learner_id int, plan_date date, task_id int, action string").repartition(3)
    want = plan_fold(actions, dt.datetime(2024, 2, 1))
    got = {(r["learner_id"], r["plan_date"], r["task_id"]): r["actual_seconds"] for r in pl.task_times(rows, "2024-02-01 00:00:00").collect()}
    assert got == {k: t["seconds"] for k, t in want.items() if t["ran"]}
    got = {(r["learner_id"], r["plan_date"], r["task_id"]): (r["status"], r["completed_at"], r["carried_to"]) for r in pl.task_status(rows).collect()}
    assert got == {k: (t["status"], t["done"], t["carried"]) for k, t in want.items()}
    assert pl.task_times(rows.limit(0), "2024-02-01 00:00:00").count() == 0
