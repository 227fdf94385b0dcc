import itertools
import math
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from paperloom.llm import langid

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    vocab = langid.Vocabulary(["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba"])
    p = np.array([[0.1, 0.2], [0.1, 0.05], [0.2, 0.1], [0.1, 0.2], [0.1, 0.1], [0.2, 0.1], [0.1, 0.1], [0.1, 0.15]])
    words = ["ab", "abab", "b", "aba", "bz"]
    got = langid.log_likelihoods(words, vocab, langid._scaled(p, vocab))
    for w, row in zip(words, got):
        text = "▁" + w
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            parts, at = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(text[at:i])
                    at = i
            value = np.ones(2)
            for x in parts:
                value = value * (p[vocab.pieces.index(x)] if x in vocab.pieces else 1e-7 if len(x) == 1 else 0)
            total += value
        assert np.allclose(row, np.log(total), atol=1e-9)


def test_lookup_finds_pieces_and_nothing_else():
    vocab = langid.vocabulary(PATH)
    assert (vocab.find(vocab.keys) == np.arange(len(vocab.keys))).all()
    others = np.random.default_rng(1).integers(1 << 40, 1 << 63, 200_000).astype(np.uint64)
    assert (vocab.find(np.setdiff1d(others, vocab.keys)) >= 0).sum() == 0


def test_expectation_maximisation_raises_the_likelihood():
    vocab = langid.vocabulary(PATH)
    words, counts = ["house", "houses", "mouse", "haus", "maus"], np.array([[5, 0], [3, 0], [4, 0], [0, 5], [0, 4.0]])
    value = [(counts * langid.log_likelihoods(words, vocab, langid._scaled(langid.fit(words, counts, vocab, n), vocab))).sum() for n in (1, 2, 4)]
    assert value[0] < value[1] < value[2]


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs.filter("doc_id < 700"), PATH)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out OR doc_id >= 700")
    right, rows = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert rows > 300 and right > 0.98


def test_cases(docs, with_null_id, empty):
    model = langid.learn(docs, PATH)
    got = {r["doc_id"]: r for r in langid.identify(with_null_id, model).collect()}
    for i in (10_000, 10_001, 10_002, 10_010):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[10_013]["lang_pred"] in model.langs and got[10_014]["lang_pred"] in model.langs
    assert all(0 <= r["score"] <= 1 and math.isfinite(r["score"]) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items() if d is not None)
    assert langid.identify(empty, model).count() == 0
    none = langid.learn(empty, PATH)
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def test_words_of_a_small_language_are_kept(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "SAMPLE_WORDS", 40)
    monkeypatch.setattr(langid, "fit", lambda words, counts, vocab: seen.update(words=words, counts=counts) or np.ones((len(vocab.pieces), counts.shape[1])))
    letters = "abcdefghijklmnopqrstuvwxyz"
    large = " ".join(a + b for a in letters for b in letters) + " "
    rows = [(i, large * 20, "xx") for i in range(60)] + [(100 + i, "kleine worte " + "q" * (i + 1), "yy") for i in range(9)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH)
    assert model.langs == ["xx", "yy"] and {"kleine", "worte"} <= set(seen["words"])
    assert (seen["counts"] > 0).sum(0).tolist()[0] == 20 and (seen["counts"] > 0).sum() <= 40
