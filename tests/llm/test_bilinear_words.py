import sys
from collections import Counter

import numpy as np

from paperloom.llm import bilinear_lm as lm


def ordered(spark, words=1500, n=900):
    """Every word has two that may follow it, whatever its frequency."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        at, text = int(rng.integers(words)), []
        for _ in range(200):
            text.append(f"w{at}")
            at = (at * 7 + int(rng.integers(2))) % words
        rows.append((i, " ".join(text)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_words_that_share_a_symbol_are_told_apart_by_context(spark):
    docs = ordered(spark)
    got = lm.score(docs, lm.learn(docs)).filter("held_out").toPandas()
    assert len(got) > 50
    print("score over base_score", got["score"].sum() / got["base_score"].sum())
    assert got["score"].sum() > 0.9 * got["base_score"].sum()


def test_chances_of_all_words_sum_to_one(docs):
    model = lm.learn(docs)
    size, symbol = len(model.lexicon.words), model.lexicon.run_symbol()
    rng = np.random.default_rng(2)
    vectors = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in model.vectors.items()}
    table = (model.table * np.log(10)).astype(np.float32)
    for two, one in [(size + 1, size + 1), (size + 1, 3), (3, size), (70, size - 1), (size - 1, 200)]:
        keys = (two << 2 * lm.BITS | one << lm.BITS) + np.arange(size + 1)
        chances = lm.log_chances(keys, symbol, model.groups, vectors, table)
        assert abs(np.exp(chances).sum() - 1) < 1e-3
        assert len(np.unique(chances[symbol[: size + 1] == lm.RARE - 1])) > 1
    assert len(vectors["word"]) == size - lm.SINGLE and len(vectors["one"]) == size + 2


def test_runs_are_counted_whole(spark, docs):
    texts = [r["text"] for r in docs.collect()]
    count = Counter(w for t in texts for w in lm.words_of(t))
    words = [w for w, n in count.items() if n > 3]
    lexicon = lm.Lexicon(words, np.array([count[w] for w in words]), count.total(), len(count))
    index, want = lexicon.index(), Counter()
    for t in texts:
        at = [len(words) + 1] * 2 + [index.get(w, len(words)) for w in lm.words_of(t)]
        want.update(zip(at, at[1:], at[2:]))
    got, mask = Counter(), (1 << lm.BITS) - 1
    for batch in lm.run_counts(docs, spark.sparkContext.broadcast(lexicon)).toArrow().to_batches():
        for keys, n in lm._unpacked(batch):
            for k, x in zip(keys.tolist(), n.tolist()):
                assert (k >> 2 * lm.BITS, k >> lm.BITS & mask, k & mask) not in got
                got[k >> 2 * lm.BITS, k >> lm.BITS & mask, k & mask] = x
    assert got == want


def test_tokens_are_numbered_some_texts_at_a_time(monkeypatch):
    """Parts of texts give the words, and runs of three, that reading text by text gives."""
    texts = ["a B a", "", None, " \t", "C\x0bd\x85e", "Ä ä a", "one " * 9, "b"]
    known = {b"a": 0, b"b": 1, lm.END: 2}
    for part in (1, 8, 1 << 20):
        monkeypatch.setattr(lm, "PART", part)
        got, runs = [], []
        for words, ids, lengths in lm.tokens_of([t and t.encode() for t in texts]):
            assert words[-1] == lm.END and len(set(words)) == len(words)
            ends = np.cumsum(lengths)
            got += [[words[i] for i in ids[a:b]] for a, b in zip(ends - lengths, ends)]
            runs += lm.runs_of(lm._known(words, known)[ids], lengths, 3).tolist()
        assert got == [lm.words_of(t) for t in texts]
        at = [[4, 4, *(known.get(w, 3) for w in lm.words_of(t))] for t in texts]
        assert runs == [a << 2 * lm.BITS | b << lm.BITS | c for x in at for a, b, c in zip(x, x[1:], x[2:])]
    assert list(lm.tokens_of([])) == []


def below(parents, rows, seed=0):
    """Rows of some parents of three children each, in order of the child, as a step has them."""
    rng = np.random.default_rng(seed)
    child = np.sort(rng.integers(3 * parents, size=rows))
    p = {"word": rng.normal(size=(3 * parents, lm.WIDTH)).astype(np.float32)}
    starts, sums = np.arange(parents + 1) * 3, np.r_[0, np.cumsum(rng.integers(1, 9, 3 * parents))].astype(float)
    context, n = rng.normal(size=(rows, lm.WIDTH)).astype(np.float32), rng.integers(1, 5, rows).astype(np.float32)
    up, back = {"word": []}, np.zeros_like(context)
    return up, p, "word", child, child // 3, starts, sums, context, back, n, np.random.default_rng(1)


def test_children_are_told_from_drawn_ones_as_parent_by_parent():
    for parents, rows in [(1, 1), (1, 5000), (40, 300), (700, 9000)]:
        given = below(parents, rows)
        up, p, kind, child, parent, starts, sums, context, back, n, _ = given
        lm._drawn_below(*given)
        rng, found = np.random.default_rng(1), np.unique(parent)
        low, high = sums[starts[found]], sums[starts[found + 1]]
        drawn = np.searchsorted(sums, low[:, None] + rng.random((len(found), lm.DRAWN)) * (high - low)[:, None], "right") - 1
        want_back, want = np.zeros(back.shape), np.zeros(p[kind].shape)
        for i, q in enumerate(found):
            for r in np.flatnonzero(parent == q):
                for w, sign in [(child[r], 1), *((w, -1) for w in drawn[i])]:
                    odds = context[r].astype(float) @ p[kind][w] - np.log(lm.DRAWN)
                    slope = n[r] * sign / (1 + np.exp(sign * odds))
                    want_back[r] += slope * p[kind][w]
                    want[w] += slope * context[r]
        got = np.zeros(want.shape)
        for at, g in up[kind]:
            np.add.at(got, at, g)
        assert np.allclose(back, want_back, atol=1e-3) and np.allclose(got, want, atol=1e-2)


def test_a_step_takes_no_more_calls_for_more_parents():
    def lines(parents):
        count, code = 0, lm._drawn_below.__code__

        def trace(frame, event, _):
            nonlocal count
            count += event == "line"
            return trace if frame.f_code is code else None

        given, before = below(parents, 4000), sys.gettrace()
        sys.settrace(trace)
        try:
            lm._drawn_below(*given)
        finally:
            sys.settrace(before)
        return count

    assert lines(1000) < 3 * lines(10)


def test_only_children_are_not_worked_on():
    up, p, kind, child, _, _, sums, *rest = below(20, 500)
    lm._drawn_below(up, p, kind, child, child, np.arange(61), sums, *rest)
    assert up == {"word": []}


def test_counts_travel_in_few_bytes():
    keys = np.array([3, 5, 1 << 59])
    for most, size in [(255, 1), (256, 2), (1 << 16, 4), (1 << 32, 8)]:
        n = np.array([1, most, 7])
        packed = lm._packed(0, keys, n)
        assert len(packed.column("n")[0].as_py()) == size * 3
        [(got, counts)] = lm._unpacked(packed)
        assert got.tolist() == keys.tolist() and counts.tolist() == n.tolist()


def test_symbols_of_runs_are_counted_whole(spark, docs):
    model = lm.learn(docs)
    shared = spark.sparkContext.broadcast(model.lexicon)
    runs = lm.run_counts(docs, shared)
    symbol, want, mask = model.lexicon.run_symbol(), Counter(), (1 << lm.BITS) - 1
    for batch in runs.toArrow().to_batches():
        for keys, n in lm._unpacked(batch):
            for k, x in zip(keys.tolist(), n.tolist()):
                two, one, last = (int(symbol[k >> b & mask]) for b in (2 * lm.BITS, lm.BITS, 0))
                want[(two * lm.SYMBOLS + one) * lm.SYMBOLS + last] += x
    got = lm._cell_counts(runs, shared)
    assert got["cell"].is_monotonic_increasing and dict(zip(got["cell"], got["n"])) == dict(want)
