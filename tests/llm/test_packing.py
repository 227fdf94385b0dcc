import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab'st 1\n\t 　é!.日\x1c\U0001f600<|>")), max_size=40))
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(packing._ids_of(PATH)(text), "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_pieces_cover_each_document(with_null_id):
    rows = with_null_id.select("doc_id", "text").distinct()
    got = packing.pieces(rows, PATH).toPandas()
    for r in rows.collect():
        ids = np.array(PLAIN.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        own = got[got["doc_id"].isna() if r["doc_id"] is None else got["doc_id"] == r["doc_id"]].sort_values("piece")
        if r["doc_id"] is None:
            continue
        assert own["length"].sum() == len(ids) and own["length"].max() <= 2048
        assert (own["length"].to_numpy()[1:] == 2048).all()
        for p in own.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in lengths:
        fits = [i for i, r in enumerate(rooms) if r >= n]
        at = min(fits, key=lambda i: rooms[i]) if fits else len(rooms)
        rooms[at : at + 1] = [(rooms[at] if fits else capacity) - n]
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_best_fit_and_bound(lengths):
    lengths = np.sort(np.array(lengths))[::-1]
    bins = packing.best_fit(lengths, 50)
    held = pd.Series(lengths).groupby(bins).sum()
    assert held.max() <= 50 and len(held) == plain_best_fit(lengths.tolist(), 50)
    assert packing.bound(lengths, 50) <= len(held)


def test_bound_sees_more_than_the_sum():
    assert packing.bound(np.array([26] * 10), 50) == 10
    assert packing.bound(np.array([17] * 9), 50) == 5


@pytest.mark.parametrize("part_pieces", [20, 10_000])
def test_sequences_are_whole_and_gapless(docs, part_pieces):
    cuts = packing.pieces(docs, PATH)
    got = packing.pack(cuts, part_pieces=part_pieces).toPandas()
    want = cuts.toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[key].to_numpy())) == sorted(map(tuple, want[key].to_numpy()))
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["length"].sum() <= 2048 and (own["offset"] == own["length"].cumsum() - own["length"]).all()
    least = -(-int(got["length"].sum()) // 2048)
    assert got["sequence_id"].nunique() <= least + 3


def test_exchange_saves_bins(spark):
    rows = [(i, 0, 0, 700 + i % 7, 0) for i in range(400)]
    cuts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert packing.pack(cuts, part_pieces=5).select("sequence_id").distinct().count() <= packing.pack(cuts, part_pieces=10_000).select("sequence_id").distinct().count() + 3


def test_parts_are_near_one_packing_of_all(spark):
    lengths = np.random.default_rng(3).integers(1, 2049, 40_000)
    rows = pd.DataFrame({"doc_id": np.arange(len(lengths)), "piece": 0, "start": 0, "length": lengths, "ids_crc32": 0})
    cuts = spark.createDataFrame(rows).withColumn("piece", F.col("piece").cast("int"))
    whole = packing.best_fit(np.sort(lengths)[::-1], 2048).max() + 1
    assert packing.pack(cuts).select("sequence_id").distinct().count() == whole
    assert packing.pack(cuts, part_pieces=5_000).select("sequence_id").distinct().count() <= 1.005 * whole


def test_empty_table(empty):
    assert packing.pack(packing.pieces(empty, PATH)).count() == 0
