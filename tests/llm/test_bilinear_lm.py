import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import bilinear_lm as lm


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [b""]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


@pytest.mark.parametrize("known", [40, 100_000])
def test_base_scores_are_the_unigram_model(docs, with_null_id, monkeypatch, known):
    monkeypatch.setattr(lm, "KNOWN_WORDS", known)
    rows = [(r["doc_id"], r["text"]) for r in with_null_id.collect()]
    count = Counter(w for d, t in rows if not held(d) for w in words(t))
    total, kinds = sum(count.values()), len(count)
    model = lm.learn(with_null_id)
    got = lm.score(with_null_id, model).collect()
    assert len(got) == len(rows) and model.lexicon.tokens == total and len(model.lexicon.words) <= known
    by_key = Counter()
    for d, t in rows:
        w = words(t)
        by_key[d, held(d), len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w), 6)] += 1
    assert by_key == Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_probabilities_of_all_words_sum_to_one(docs, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN_WORDS", 200)
    model = lm.learn(docs)
    x = model.lexicon
    inside = np.zeros(lm.SYMBOLS)
    np.add.at(inside, x.symbol[:-1], 10 ** x.log_share[:-1])
    rare = model.counts.filter(~model.counts["word"].isin([bytearray(w) for w in x.words])).toPandas()["n"]
    inside[lm.RARE] = (rare.sum() + len(rare) + 1) / (x.rare_tokens + x.rare_kinds + 1)  # and one unseen word
    filled = np.flatnonzero(inside)
    assert np.allclose(inside[filled], 1)
    assert np.allclose((10**model.table).sum(1), 1)


def test_training_beats_unigrams_on_text_with_order(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        at, text = int(rng.integers(20)), []
        for _ in range(60):
            text.append(f"w{at}")
            at = (at * 3 + int(rng.integers(2))) % 20
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.score(docs, lm.learn(docs)).filter("held_out").toPandas()
    assert len(got) > 20 and got["score"].sum() > 0.6 * got["base_score"].sum()


def test_contexts():
    got = lm.contexts(np.array([4, 5, 6]))
    assert [divmod(int(c), lm.SYMBOLS) for c in got] == [(lm.START, lm.START), (lm.START, 4), (4, 5)]


def test_empty_tables(docs, empty):
    model = lm.learn(empty)
    got = lm.score(docs, model).collect()
    assert lm.score(empty, model).count() == 0
    assert all(r["n_known"] == 0 and r["base_score"] == 0.0 and math.isfinite(r["score"]) for r in got)
