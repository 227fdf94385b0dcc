"""Language identification by unigrams over pieces, summed over all segmentations of each word.

Every language has a probability for each piece of a fixed public vocabulary, fitted by
expectation-maximisation. The probability of a word is the sum over all ways to cut it into
pieces, which a forward algorithm finds; a text's is the product over its words.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, mapped

#: Training documents of each language, at most, and pairs of a language and a word kept of them,
#: of which each language has an equal part.
SAMPLE_DOCS = 1_500
SAMPLE_WORDS = 150_000
ROUNDS = 4
HELD_OUT_MOD, HELD_OUT = 3, 1
UNDETERMINED = "und"
#: Words that a task remembers at once.
REMEMBERED = 300_000

#: Longest run of letters that is one word; longer runs are several words.
WORD = 32
_WORDS = re.compile(rf"[^\W\d_]{{1,{WORD}}}")
_START = "▁"
#: Probability of a character that the vocabulary doesn't hold, in every language.
_UNKNOWN = 1e-7
#: Factor by which each character scales a piece's probability, to keep products near 1.
_SCALE = 12.0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 20


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return _WORDS.findall((text or "").lower())


class Vocabulary:
    """Pieces by the hash of their characters, so that all substrings of many words are looked up
    at once. A rolling hash of a word's prefixes gives the hash of any substring."""

    def __init__(self, pieces: list[str]):
        self.pieces = sorted(set(pieces))
        self.longest = max(map(len, self.pieces))
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(WORD + 1, _BASE)], dtype=np.uint64)
        keys = np.array([self._hash(p) for p in self.pieces], np.uint64)
        self.slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.keys, self.probes = keys, 1
        for i, at in enumerate(self._slot(keys).tolist()):
            tries = 1
            while self.slots[at] >= 0:
                at, tries = (at + 1) % len(self.slots), tries + 1
            self.slots[at] = i
            self.probes = max(self.probes, tries)

    def _hash(self, piece: str) -> np.uint64:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return np.uint64(h)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((keys ^ (keys >> np.uint64(31))) * _BASE) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or -1."""
        at = self._slot(keys)
        out = self.slots[at]
        open_rows = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        for step in range(1, self.probes + 1):
            if not len(open_rows):
                break
            held = self.slots[(at[open_rows] + step) % len(self.slots)]
            out[open_rows] = held
            open_rows = open_rows[(held >= 0) & (self.keys[held] != keys[open_rows])]
        out[open_rows] = -1
        return out

    def cuts(self, words: list[str]):
        """Blocks of words of equal length: (their places, length, [(start, end, rows, pieces)])."""
        order: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            order.setdefault(len(w), []).append(i)
        for length, places in order.items():
            codes = np.array([np.frombuffer((_START + words[i]).encode("utf-32-le", "surrogatepass"), np.uint32) for i in places], np.uint64)
            size = length + 1
            prefix = np.zeros((len(places), size + 1), np.uint64)
            with np.errstate(over="ignore"):
                for j in range(size):
                    prefix[:, j + 1] = prefix[:, j] * _BASE + codes[:, j] + np.uint64(1)
                found = []
                for end in range(1, size + 1):
                    for start in range(max(0, end - self.longest), end):
                        piece = self.find(prefix[:, end] - prefix[:, start] * self.powers[end - start])
                        rows = np.flatnonzero(piece >= 0)
                        if end == start + 1 and len(rows) < len(places):
                            lost = np.flatnonzero(piece < 0)
                            found.append((start, end, lost, np.full(len(lost), len(self.pieces))))
                        if len(rows):
                            found.append((start, end, rows, piece[rows]))
            yield np.array(places), size, found


@lru_cache(maxsize=2)
def vocabulary(model: str) -> Vocabulary:
    """The pieces of a public sentencepiece model, without its control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return Vocabulary([sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))])


def _scaled(p: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Piece probabilities with the scale of their length and a last row for unknown characters."""
    lengths = np.array([len(x) for x in vocab.pieces] + [1])
    return np.vstack([p, np.full((1, p.shape[1]), _UNKNOWN)]) * _SCALE ** lengths[:, None]


def log_likelihoods(words: list[str], vocab: Vocabulary, scaled: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each word in each language, over all segmentations."""
    out = np.empty((len(words), scaled.shape[1]))
    for places, size, found in vocab.cuts(words):
        forward = np.zeros((size + 1, len(places), scaled.shape[1]))
        forward[0] = 1
        for start, end, rows, piece in found:
            forward[end, rows] += forward[start, rows] * scaled[piece]
        out[places] = np.log(np.maximum(forward[size], 1e-300)) - size * np.log(_SCALE)
    return out


def fit(words: list[str], counts: np.ndarray, vocab: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities [piece, language] from counts [word, language]."""
    size, langs = len(vocab.pieces), counts.shape[1]
    p = np.full((size, langs), 1.0 / size)
    for _ in range(rounds):
        scaled, expected = _scaled(p, vocab), np.zeros((size + 1, langs))
        for at in range(0, len(words), 20_000):
            for places, n, found in vocab.cuts(words[at : at + 20_000]):
                forward, backward = np.zeros((2, n + 1, len(places), langs))
                forward[0] = backward[n] = 1
                for start, end, rows, piece in found:
                    forward[end, rows] += forward[start, rows] * scaled[piece]
                for start, end, rows, piece in sorted(found, key=lambda x: -x[0]):
                    backward[start, rows] += backward[end, rows] * scaled[piece]
                weight = counts[at + places] / np.maximum(forward[n], 1e-300)
                pieces = np.concatenate([x[3] for x in found])
                share = np.concatenate([forward[s, r] * scaled[i] * backward[e, r] * weight[r] for s, e, r, i in found])
                for lang in range(langs):
                    expected[:, lang] += np.bincount(pieces, share[:, lang], size + 1)
        p = expected[:size] + 0.01
        p /= p.sum(0)
    return p


class Model:
    def __init__(self, langs: list[str], p: np.ndarray, path: str):
        self.langs, self.p, self.path = langs, p, path


def learn(docs: DataFrame, model: str) -> Model:
    """Piece probabilities from at most ``SAMPLE_DOCS`` training documents of each language.

    Training documents have a language and a crc32 of the id whose remainder by 3 is not 1; of
    these, the ones with the least hash of their id. Of their words, the most frequent of each
    language are used, ``SAMPLE_WORDS`` by the number of languages of each; of words that occur as
    often the first by spelling. Without any, every text is undetermined.
    """
    train = docs.filter(F.col("lang").isNotNull() & (crc_mod("doc_id", HELD_OUT_MOD) != HELD_OUT))
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, SAMPLE_DOCS / n) * (1 << 30)))).otherwise(share)
    chosen = train.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1 << 30)) < share).select("lang", "text")

    def splitter():
        def split(batch: dict) -> dict:
            pairs = pd.Series([(g, w) for g, t in zip(batch["lang"], batch["text"]) for w in words_of(t)], dtype=object).value_counts()
            return {"lang": [k[0] for k in pairs.index], "word": [k[1] for k in pairs.index], "n": pairs.to_numpy()}

        return split

    counted = mapped(chosen, splitter, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    # The window keeps the first of each task before it shuffles.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    rows = counted.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE_WORDS // max(1, len(langs))).drop("rank").toPandas()
    counted.unpersist()
    table = rows.pivot(index="word", columns="lang", values="n").reindex(columns=langs).fillna(0.0).sort_index() if len(rows) else None
    if table is None:
        return Model([], np.zeros((len(vocabulary(model).pieces), 0)), model)
    return Model(langs, fit(table.index.tolist(), table.to_numpy(float), vocabulary(model)), model)


class Scorer:
    """Language and score of texts; remembers the likelihoods of words between batches."""

    def __init__(self, model: Model):
        self.langs, self.vocab = model.langs, vocabulary(model.path)
        self.scaled = _scaled(model.p, self.vocab)
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.langs)))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [words_of(t) for t in texts]
        if len(self.index) > REMEMBERED:
            self.index, self.rows = {}, self.rows[:0]
        new = sorted(set().union(*split) - self.index.keys()) if split else []
        if new and self.langs:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.rows = np.concatenate([self.rows, log_likelihoods(new, self.vocab, self.scaled)])
        return [self._best(words) for words in split]

    def _best(self, words: list[str]) -> tuple[str, float]:
        # The runs may also hold numerals such as a half; a text of these only has no letter.
        if not self.langs or not any(any(map(str.isalpha, w)) for w in words):
            return UNDETERMINED, 0.0
        total = self.rows[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))].sum(0)
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    The score is the probability of the language, all being as likely beforehand. A text without a
    letter, null or empty, is ``und`` with score 0. Of equally likely languages the first by name
    counts. Only the text is looked at; rows that repeat get the same; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        score = Scorer(shared.value)

        def scored(batch: dict) -> dict:
            found = []
            for at in range(0, len(batch["text"]), 1_000):
                found += score(batch["text"][at : at + 1_000])
            return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

        return scored

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", (crc_mod("doc_id", HELD_OUT_MOD) == HELD_OUT).alias("held_out"), "text")
    return mapped(rows, scorer, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
