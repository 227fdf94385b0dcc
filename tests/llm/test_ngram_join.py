import random
import re
from collections import defaultdict

import numpy as np
import pytest

from paperloom.llm import ngram_join


def brute(rows, n, num, den):
    sets = []
    for d, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append((d, frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])))
    parent = {d: d for d, _ in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = defaultdict(list)
    for at, (d, s) in enumerate(sets):
        for m in {m for g in s for m in holders[g]}:
            both = len(s & sets[m][1])
            if den * both >= num * (len(s) + len(sets[m][1]) - both):
                a, b = root(d), root(sets[m][0])
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(at)
    return sorted((d, len(s), root(d)) for d, s in sets)


def near(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"z{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 1, 1)])
def test_components_match_all_pairs(spark, docs, n, num, den):
    rng = random.Random(n)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for group in range(40):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 15, 22, 40, 120]))]
        for copy in range(rng.choice([1, 2, 6])):
            rows.append((20_000 + 100 * group + copy, near(rng, base, rng.choice([0, 0, 1, 2, 4]))))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.linked(frame, n, num, den).collect())
    assert got == brute(rows, n, num, den)


def test_leaderless_links_are_found(spark, monkeypatch):
    """A chain: each set is similar to the next one only, and none is to the first of its list."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(f"q{j}" if j < 3 * i else w for j, w in enumerate(base))) for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.linked(frame, 1, 85, 100).collect())
    assert got == brute(rows, 1, 85, 100)


def test_frequent_shingles_change_the_order_only(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON_LEAST", 1)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"u{rng.randrange(90)}" for _ in range(rng.choice([2, 5, 60])))) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.linked(frame, 3, 90, 100).collect())
    assert got == brute(rows, 3, 90, 100)


def test_null_ids_and_empty(with_null_id, empty):
    got = [r for r in ngram_join.linked(with_null_id).collect() if r["doc_id"] is None]
    assert sorted((r["n_shingles"], r["component_id"]) for r in got) == [(0, None), (2, None)]
    assert ngram_join.linked(empty).count() == 0


def test_one_of_each_component_stays(docs):
    kept = ngram_join.drop_near_copies(docs)
    found = {r["doc_id"] for r in ngram_join.linked(docs, 5, 80, 100).collect() if r["doc_id"] == r["component_id"]}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == found


def test_rule_covers_every_pair():
    for num, den in ((90, 100), (80, 100)):
        rule = ngram_join.Rule(num, den)
        for a in range(1, 60):
            for b in range(rule.smallest(a), a + 1):
                need = rule.overlap(a, b)
                assert need > a - rule.prefix(a) and need in rule.subset_sizes(a) and need in rule.subset_sizes(b)
                least = next(o for o in range(b + 1) if den * o >= num * (a + b - o))
                assert need == least


def test_subset_keys_tell_which_element_is_left_out():
    values = np.array([3, 10, 500, 7_000], np.int64)
    assert sorted(ngram_join._subsets(values, 2)) == sorted(int(a + b) for i, a in enumerate(values) for b in values[i + 1 :])


def test_names_may_clash(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 1), (3, "other words than these five", 2)], "doc_id long, text string, Other long")
    got = ngram_join.drop_near_copies(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3]
