"""Segments against the plain fold, and records that are deleted."""

import random
import re

from paperloom.operators import records as rc, segments as sg


def plain(text, limit):
    out, current = [], []
    for block in re.split(r"\n\s*\n", text.strip()) if text and text.strip() else []:
        if current and sum(map(len, current)) + len(block) > limit:
            out.append("\n\n".join(current))
            current = []
        current.append(block)
    return out + (["\n\n".join(current)] if current else [])


def test_segments_match_a_fold(spark):
    rng = random.Random(7)
    texts = [None, "", " \n ", "one", "a\n\nb", "x" * 300, "\n\n".join("y" * rng.choice([1, 40, 99, 100, 101, 250]) for _ in range(400)), "\n\n".join(["z"] * 2500)]
    texts += ["".join(rng.choice(["w" * rng.randrange(1, 60), "é", "line\nline"]) + rng.choice(["\n\n", "\n \t\n", "\n\n\n\n", " "]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {(r["doc_id"], r["page"]): r["text"] for r in sg.segment_documents(docs, 100).collect()}
    assert got == {(i, n): t for i, text in enumerate(texts) for n, t in enumerate(plain(text, 100), 1)}
    assert sg.segment_documents(docs.limit(0)).count() == 0


def test_deletions_of_unknown_records_are_rejected(spark):
    records = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "record_id int, body string")
    kept, rejects = rc.delete_records(records, spark.createDataFrame([(2, 10), (2, 11), (9, 12)], "record_id int, seq int"), ["record_id"])
    assert sorted(r["record_id"] for r in kept.collect()) == [1, 3] and sorted(tuple(r) for r in rejects.collect()) == [(2, 11), (9, 12)]
