"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are runs of one word less than the longest phrase, edges are the longest phrases, weighted by
their occurrences. Spark aggregates the edges; the count of a shorter phrase is the flow out of the
nodes that begin with it, plus the ends of pieces, where a run stops before it fills an edge. A node
all of whose flow passes one edge is on a unary path and is compacted into that edge, so only
phrases that branch on both sides are reported.

A pair of words that occurs less than the least count is in no phrase, so pieces are cut there first.
Which pairs may be that frequent is kept in a bit map of fixed size: pairs that share a bucket count
together, so it keeps some too many and none too few.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from . import sketch
from .common import split_words, written

#: Buckets of word pairs: their bits are broadcast, 2 MB whatever the input.
BITS = 24
#: Bytes of text handled at one time.
BLOCK = 8 << 20
#: Parts of a language that are ranked on their own first.
PARTS = 64
UNKNOWN = "und"

_CUT = b"\xff"  # stands in no UTF-8 text
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 0xFF if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


class _Block:
    """Words of some texts as numbers: ``ids`` (0 where a piece ends), ``langs`` beside them, and what the numbers stand for."""

    def __init__(self, langs: list[str | None], texts: list[bytes | None]):
        known: dict[bytes, int] = {_CUT: 0}
        named: dict[str, int] = {}
        flat = array("i")
        lengths = []
        for text in texts:
            before = len(flat)
            for words in split_words((text or b"").translate(_LOWER).replace(_CUT, b" \xff ")):
                flat.extend([known.setdefault(word, len(known)) for word in words])
            flat.append(0)
            lengths.append(len(flat) - before)
        self.words, self.names = list(known), []
        for lang in langs:
            named.setdefault(UNKNOWN if lang is None else lang, len(named))
        self.names = list(named)
        self.ids = np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)
        self.langs = np.repeat(np.array([named[UNKNOWN if x is None else x] for x in langs], np.int32), lengths)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a word and its successor are of one piece, and the bucket of the two."""
        inside = np.zeros(len(self.ids), bool)
        inside[:-1] = (self.ids[:-1] != 0) & (self.ids[1:] != 0)
        word = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))[self.ids]
        lang = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in self.names), np.uint64, len(self.names))[self.langs]
        with np.errstate(over="ignore"):
            x = (word * _ODD[0]) ^ (np.roll(word, -1) * _ODD[1] + lang)
            x = (x ^ (x >> np.uint64(31))) * _ODD[2]
        return inside, (x >> np.uint64(64 - BITS)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """Whole texts in blocks of about ``BLOCK`` bytes; a longer text is a block of its own."""
    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            langs.append(lang)
            texts.append(text)
            size += len(text or b"")
            if size >= BLOCK:
                yield _Block(langs, texts)
                langs, texts, size = [], [], 0
    if texts:
        yield _Block(langs, texts)


def _counted(rows: DataFrame, least: int) -> DataFrame:
    """Occurrences of words a block (lang, word, n), and of a task's pairs a chunk of buckets
    (chunk, task, at, held: positions in the chunk and counts up to ``least`` as packed numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        buckets = np.zeros(1 << BITS, "u2" if least < 1 << 16 else "u4")

        def batch(lang, word, n, chunk, at, held):
            columns = [pa.array(lang, pa.string()), word, pa.array(n, pa.int64()), pa.array(chunk, pa.int32()), pa.array([task] * len(chunk), pa.int32()), pa.array(at, pa.binary()), pa.array(held, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n", "chunk", "task", "at", "held"])

        for block in _blocks(batches):
            inside, bucket = block.pairs()
            found, n = np.unique(bucket[inside], return_counts=True)
            buckets[found] = np.minimum(buckets[found] + n, least)
            keys, n = np.unique(block.langs[block.ids > 0].astype(np.int64) * len(block.words) + block.ids[block.ids > 0], return_counts=True)
            words = pa.array(block.words, pa.binary()).take(pa.array(keys % len(block.words))).cast(pa.string())
            langs = pa.array(block.names, pa.string()).take(pa.array(keys // len(block.words)))
            none = [None] * len(keys)
            yield batch(langs, words, n, none, none, none)
        for chunk, at, held in sketch.chunks(buckets):
            yield batch([None], pa.array([None], pa.string()), [None], [chunk], [at], [held])

    return rows.mapInArrow(run, "lang string, word string, n long, chunk int, task int, at binary, held binary")


def _frequent_pairs(counted: DataFrame, least: int) -> np.ndarray:
    """Bits of the buckets that hold ``least`` pairs or more."""
    return sketch.collected(counted.filter("chunk IS NOT NULL"), 1 << BITS, lambda total: np.packbits(total >= least))


def _grams(rows: DataFrame, bits: np.ndarray, longest: int) -> DataFrame:
    """lang, gram, k: what starts at every word whose next pair may be frequent, ``longest`` words or
    as many as there are before the cut. Those of ``longest`` words are edges."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(shared.value).view(bool)
        for block in _blocks(batches):
            inside, bucket = block.pairs()
            goes = inside & often[bucket]
            k = np.ones(len(goes), np.int32)
            on = goes.copy()
            for step in range(1, longest):
                k += on
                on[: len(on) - step] &= goes[step:]
                on[len(on) - step :] = False
            at = np.flatnonzero(goes)
            size = k[at]
            padded = np.concatenate([block.ids, np.zeros(longest, np.int32)])
            words = pa.array(block.words, pa.binary())
            parts = [words.take(pa.array(padded[at + i], mask=size <= i)) for i in range(longest)]
            gram = pc.binary_join_element_wise(*parts, pa.scalar(b" "), null_handling="skip").cast(pa.string())
            lang = pa.array(block.names, pa.string()).take(pa.array(block.langs[at]))
            yield pa.RecordBatch.from_arrays([lang, gram, pa.array(size)], names=["lang", "gram", "k"])

    return rows.mapInArrow(run, "lang string, gram string, k int")


def _first(gram: str, k: int | Column) -> Column:
    return F.substring_index(F.col(gram), " ", k) if isinstance(k, int) else F.call_function("substring_index", F.col(gram), F.lit(" "), k)


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(words, phrases): lang, word, n of every word; lang, gram, k, n of every phrase of 1 to
    ``longest`` words that occurs ``least`` times or more."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = written(_counted(rows, least), "counted")
    words = written(counted.filter("chunk IS NULL").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    edges = _grams(rows, _frequent_pairs(counted, least), longest).groupBy("lang", "gram", "k").agg(F.count(F.lit(1)).alias("n"))
    edges = written(edges, "edges")
    flow = edges.filter(F.col("k") == longest).select("lang", "gram", "n")
    found = flow.filter(F.col("n") >= least).withColumn("k", F.lit(longest))
    for k in range(longest - 1, 1, -1):
        ends = edges.filter(F.col("k") == k).select("lang", "gram", "n")
        flow = flow.select("lang", _first("gram", k).alias("gram"), "n").unionByName(ends).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        flow = written(flow, "nodes") if k > 2 else flow
        found = found.unionByName(flow.filter(F.col("n") >= least).withColumn("k", F.lit(k)))
    found = found.unionByName(words.filter(F.col("n") >= least).select("lang", F.col("word").alias("gram"), "n", F.lit(1).alias("k")))
    return words, written(found, "phrases")


def _scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, gram, k, a, l, r, n, score of every phrase of two words or more, by its lowest-scoring cut."""
    cuts = phrases.filter("k > 1").select("lang", "gram", "k", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"first": _first("gram", F.col("cut")), "rest": _first("gram", F.col("cut") - F.col("k"))})
    left = phrases.select("lang", F.col("gram").alias("first"), F.col("n").alias("l"))
    right = phrases.select("lang", F.col("gram").alias("rest"), F.col("n").alias("r"))
    joined = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    big = lambda c, digits: c.cast(DecimalType(digits, 0))
    above = big(F.col("a") * 1000, 19) * big(F.col("n"), 18)
    below = big(F.col("l"), 18) * big(F.col("r"), 18)
    best = F.min(F.struct(F.call_function("div", above, below).alias("score"), "cut", "l", "r", "n")).alias("best")
    return joined.groupBy("lang", "gram", "k", "a").agg(best).select("lang", "gram", "k", "a", "best.l", "best.r", "best.n", "best.score")


def _compacted(scored: DataFrame) -> DataFrame:
    """Without the phrases that lie on a unary path: those that a phrase of one word more carries
    whole. A longer phrase that does so makes all between the two do it, so one word is enough."""
    inner = F.explode(F.array(_first("gram", F.col("k") - 1), _first("gram", 1 - F.col("k")))).alias("gram")
    flow = scored.filter("k > 2").select("lang", inner, "a").groupBy("lang", "gram").agg(F.max("a").alias("most"))
    return scored.join(flow, ["lang", "gram"], "left").filter(F.col("most").isNull() | (F.col("most") < F.col("a"))).drop("most")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2_000, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    Texts are cut into pieces at ``.,;:!?`` and line ends, and pieces into words at blanks and tabs,
    with A-Z in lower case; phrases don't cross pieces. A null language counts as ``und``, a null or
    empty text has no words, repeated rows count each, ties are ranked by count and then phrase, and
    an empty table gives no rows. Other columns aren't looked at. Counts are exact for texts of any
    length.
    """
    words, phrases = phrase_counts(docs, least, longest, lang, text)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    found = written(_compacted(written(_scored(phrases, totals), "scored")), "found")
    order = [F.desc("score"), F.desc("a"), F.asc("gram")]
    # Each part of a language drops what its own better phrases push out.
    part = F.pmod(F.xxhash64("gram"), F.lit(PARTS))
    first = found.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), F.col("gram").alias("phrase"), "a", "l", "r", "n", "score")
