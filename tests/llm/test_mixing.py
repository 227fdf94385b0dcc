import math
import random
from collections import defaultdict

import pytest

from paperloom.llm import mixing


def plain_exponent(tokens, budget, share, repeats):
    """By bisection of each bound on its own."""
    p = [t / sum(tokens) for t in tokens]

    def entropy(a):
        w = [x**a for x in p]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    def most(a):
        w = [x**a for x in p]
        return max(x / sum(w) * budget / t for x, t in zip(w, tokens))

    def bisect(keeps, low, high):
        """keeps(low) holds, keeps(high) may not."""
        if keeps(high):
            return high
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if keeps(mid) else (low, mid)
        return low

    by_entropy = bisect(lambda a: entropy(a) >= share * math.log(len(p)), 0.0, 1.0)
    by_repeats = bisect(lambda a: most(a) <= repeats, 1.0, 0.0)
    return max(by_entropy, by_repeats)


@pytest.mark.parametrize(("tokens", "share", "repeats"), [([9000, 500, 400, 100], 0.9, 100.0), ([9000, 500, 400, 100], 0.9, 3.0), ([10, 10, 10], 0.9, 4.0), ([9000, 10], 0.99, 2.0)])
def test_exponent_matches_bisection(spark, tokens, share, repeats):
    sources = spark.createDataFrame([(t / sum(tokens),) for t in tokens], "p double")
    got = mixing.exponent(sources, 1.0, share, repeats)
    assert abs(got - plain_exponent(tokens, sum(tokens), share, repeats)) < 2e-6


def test_draws_match_a_plain_version(spark):
    rng = random.Random(2)
    rows = [(i, "big" if i % 3 else f"s{i % 12}", " ".join(["w"] * rng.randrange(1, 30))) for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    got = mixing.drawn(docs).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3_000))
    total, blocks, weight, places = defaultdict(int), defaultdict(int), {}, defaultdict(dict)
    for r in got:
        assert r["n_tokens"] == len(rows[r["doc_id"]][2].split())
        total[r["source"]] += r["n_tokens"]
        blocks[r["source"], r["block"]] += r["n_tokens"]
        weight[r["source"]] = r["weight"]
        assert r["copies"] == len(r["places"])
        for x in r["places"]:
            assert places[r["source"], x["epoch"]].setdefault(x["place"], r["block"]) == r["block"]
    everything = sum(total.values())
    names = sorted(total)
    a = plain_exponent([total[s] for s in names], everything, mixing.ENTROPY_SHARE, mixing.MOST_REPEATS)
    z = sum((total[s] / everything) ** a for s in names)
    for s in names:
        assert abs(weight[s] - (total[s] / everything) ** a / z) < 1e-5
        epochs = round(weight[s] * everything / total[s], 6)
        mine = {b for n, b in blocks if n == s}
        for epoch in range(int(epochs)):
            assert sorted(places[s, epoch]) == list(range(len(mine))) and set(places[s, epoch].values()) == mine
        last = [b for _, b in sorted(places[s, int(epochs)].items())]
        part = (epochs - int(epochs)) * total[s]
        used = sum(blocks[s, b] for b in last)
        assert len(set(last)) == len(last)
        # No block that is left would bring the source nearer to its part, and none taken is too much.
        assert all(abs(used + blocks[s, b] - part) >= abs(used - part) - 1e-3 for b in mine - set(last))
        assert not last or used - part <= blocks[s, last[-1]] / 2 + 1e-3
        if int(epochs) >= 2 and len(mine) > 8:
            assert [places[s, 0][i] for i in range(len(mine))] != [places[s, 1][i] for i in range(len(mine))]
    share = {s: sum(r["n_tokens"] * r["copies"] for r in got if r["source"] == s) for s in names}
    assert abs(sum(share.values()) / everything - 1) < 0.02 and share["big"] < total["big"]


def test_a_long_block_does_not_end_an_epoch(spark):
    rows = [(i, "small", "w " * 400) for i in range(3)] + [(10 + i, "large", "w " * 100) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.drawn(docs, budget=1_000).collect()
    for name in ("small", "large"):
        mine = [r for r in got if r["source"] == name]
        sizes = [400] if name == "small" else [100]
        assert abs(sum(r["n_tokens"] * r["copies"] for r in mine) - mine[0]["weight"] * 1_000) <= max(sizes) * 2
        assert any(r["copies"] for r in mine)


def test_names_may_clash(spark):
    docs = spark.createDataFrame([(1, "a", "one two", 5, 6, 7), (2, None, "three", 8, 9, 10)], "doc_id long, source string, text string, block int, `Same` int, place int")
    got = mixing.mixed(docs, epoch="turn")
    assert got.columns == [*docs.columns, "turn"] and sorted({tuple(r)[:6] for r in got.collect()}) == [(1, "a", "one two", 5, 6, 7), (2, None, "three", 8, 9, 10)]


def test_rows_are_drawn_as_planned(spark, with_null_id):
    got = mixing.mixed(with_null_id)
    assert got.columns == with_null_id.columns
    planned = mixing.drawn(with_null_id)
    assert planned.count() == with_null_id.count()
    assert got.count() == sum(r["copies"] for r in planned.collect())
    # All sources at half their tokens: about half the documents, none twice.
    half = mixing.drawn(with_null_id, budget=planned.groupBy().sum("n_tokens").first()[0] // 2).collect()
    assert {r["copies"] for r in half} <= {0, 1}


def test_empty_tables(spark, empty):
    assert mixing.drawn(empty).count() == 0 and mixing.mixed(empty).count() == 0
    silent = spark.createDataFrame([(1, None, None), (2, "a", "")], "doc_id long, source string, text string")
    assert [r["copies"] for r in mixing.drawn(silent).collect()] == [1, 1]
