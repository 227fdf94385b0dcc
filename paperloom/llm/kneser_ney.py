"""Rules on texts: plain counts, then a band of n-gram perplexity for each language.

Spark counts the words of all documents and all pairs of them. The model is modified Kneser-Ney of order
two: three discounts a language, pairs above continuation counts above a uniform floor. Its frequent words
are held in arrays sorted by hash and looked up by binary search, a whole batch at a time. All other words
stay in a table by buckets of words, each with the pairs that it begins and ends. Counts of pairs of held
words that don't fit the arrays stay in a table by buckets of pairs. Blocks of texts ask each bucket for
the sorted list of what they lack and get its figures in the same order.

A document is rejected if its perplexity lies far above or below those of its language.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, least_of, numbered_words, written

#: Words of all languages together that every task holds, shared out evenly; pairs of them whose counts it holds.
KNOWN_MOST, PAIRS_MOST = 1 << 16, 1 << 19
#: Words of the texts for each bucket of pairs, and for each one of words.
BUCKET_WORDS = 1 << 21
#: Rounds at most in which texts are scored: their blocks, and what these shuffle, are on disk for one round only.
ROUNDS = 4
#: A band reaches from the median of log perplexity so many times as far as its 1st and 99th percentile.
BELOW, ABOVE = 1.5, 3.0
#: Documents of a language that its band needs at least; languages with fewer have none.
BAND_LEAST = 20
LEAST_WORDS = 50
#: Bytes of text handled at one time.
BLOCK = 8 << 20
UNKNOWN_LANG = "und"

_BLANK = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_INNER = bytes(range(0x80, 0xC0))  # bytes that begin no code point
_EDGE = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
#: What no word can be: the symbol at both ends of a text, and the one for words that aren't held.
_BORDER, _RARE = b" ", b"  "

# Columns of the table of pairs and words; rows of pairs have none of the last three.
_COLUMNS, _KINDS = ["bucket", "pairs", "n", "words", "homes", "sizes"], [pa.int64()] + [pa.binary()] * 5
# Of a position as a context: its pairs' counts, the pairs, those counted once to four times; the pairs it ends.
# Behind them, of a language's words that aren't held, at its ``_RARE``: how many, those that end one to four pairs.
_SUMS = ["n", "kinds", "n1", "n2", "n3", "n4", "before", "words", "b1", "b2", "b3", "b4"]
#: What marks the hash of a word that isn't held, beside positions of held ones.
_OTHER = np.uint64(1 << 63)


def _hash(word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(word, seed) >> 1


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))


class _Block:
    """Some rows: words as numbers (``ids``), the row each is of (``rows``), and the words' symbols
    (hashes of a word in lower case without digits and outer punctuation, for each language)."""

    def __init__(self, ids: list, langs: list[str | None], texts: list[bytes | None]):
        self.doc_ids, self.langs, self.texts = ids, [UNKNOWN_LANG if x is None else x for x in langs], texts
        self.words, self.ids, self.lengths = numbered_words([text or b"" for text in texts])
        self.rows = np.repeat(np.arange(len(texts)), self.lengths)

    def by_language(self) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Each language with its words' places, their numbers, its distinct words' numbers and how often
        each is there, and the hashes of their symbols."""
        plain = [x.strip(_EDGE) or x for x in (w.translate(_PLAIN) for w in self.words)]
        named = {x: i for i, x in enumerate(dict.fromkeys(self.langs))}
        lang_of = np.array([named[x] for x in self.langs], np.int16 if len(named) < 1 << 15 else np.int64)[self.rows]
        for lang, i in named.items():
            at = np.flatnonzero(lang_of == i)
            n = np.bincount(self.ids[at], minlength=len(self.words))
            used = np.flatnonzero(n)
            seed = _seed(lang)
            yield lang, at, used, n[used], np.fromiter((_hash(plain[i], seed) for i in used.tolist()), np.int64, len(used))

    def each(self, values: Callable[[str, np.ndarray], np.ndarray]) -> np.ndarray:
        """A value for every word, by its language and the hash of its symbol."""
        out, of = np.zeros(len(self.ids), np.int64), np.zeros(len(self.words), np.int64)
        for lang, at, used, _, symbols in self.by_language():
            of[used] = values(lang, symbols)
            out[at] = of[self.ids[at]]
        return out

    def repeated(self) -> np.ndarray:
        """Words of each text that stand in a window of three words found twice or more in it."""
        n = len(self.ids)
        total = np.zeros(len(self.texts), np.int64)
        if n < 3:
            return total
        kinds = len(self.words)
        inside = self.rows[:-2] == self.rows[2:]
        at = np.flatnonzero(inside)
        if not len(at):
            return total
        # Windows whose mixed numbers meet no other's are alone; only the rest is compared word by word.
        mixed = self.rows[at].astype(np.uint64)
        for step in range(3):
            mixed = (mixed ^ self.ids[at + step].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        order = np.argsort(mixed)
        alike = mixed[order[1:]] == mixed[order[:-1]]
        at = at[np.sort(order[np.r_[alike, False] | np.r_[False, alike]])]
        if not len(at):
            return total
        pair, inverse = np.unique(self.ids[at].astype(np.int64) * kinds + self.ids[at + 1], return_inverse=True)
        key = inverse.astype(np.int64) * kinds + self.ids[at + 2]
        spread = len(pair) * kinds
        if spread * len(self.texts) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            spread = int(key.max()) + 1
        _, inverse, count = np.unique(self.rows[at] * spread + key, return_inverse=True, return_counts=True)
        start = at[count[inverse] > 1]
        covered = np.zeros(n, bool)
        for step in range(3):
            covered[start + step] = True
        return total + np.bincount(self.rows[covered], minlength=len(total))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """Rows (doc_id, lang, text) in blocks of about ``BLOCK`` bytes of whole texts."""
    held: list[list] = [[], [], []]
    size = 0
    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
            for column, value in zip(held, row):
                column.append(value)
            size += len(row[2] or b"")
            if size >= BLOCK or len(held[0]) >= 100_000:
                yield _Block(*held)
                held, size = [[], [], []], 0
    if held[0]:
        yield _Block(*held)


# Numbers in few bytes ----------------------------------------------------------------------


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0, their first bytes before their second ones and so on, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    planes = pa.decompress(b[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").ravel().astype(np.int64)


def _steps(x: np.ndarray) -> bytes:
    """Sorted numbers by their differences."""
    return _packed(np.diff(x, prepend=0))


def _from_steps(b: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(b))


@dataclass(frozen=True)
class _Dealt:
    """Pairs of ``size`` positions as numbers in mixed order, dealt in ``buckets`` ranges of them."""

    size: int
    buckets: int

    _ODD = 0x9E3779B97F4A7C15

    @property
    def bits(self) -> int:
        return max(1, (self.size * self.size - 1).bit_length())

    def _times(self, x: np.ndarray, factor: int) -> np.ndarray:
        mixed = x.astype(np.uint64) * np.uint64(factor % (1 << 64))
        return (mixed & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def mixed(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return self._times(before.astype(np.int64) * self.size + after, self._ODD)

    def pair(self, mixed: np.ndarray) -> np.ndarray:
        """before << 32 | after"""
        plain = self._times(mixed, pow(self._ODD, -1, 1 << self.bits))
        return (plain // self.size << 32) | plain % self.size

    def parts(self, mixed: np.ndarray, bits: int | None = None) -> Iterator[tuple[int, int, int]]:
        """Buckets of sorted ones that have any, with the place of their first one and behind their last."""
        width = -(-(1 << (bits or self.bits)) // self.buckets)
        used, first = np.unique(mixed.astype(np.uint64) // np.uint64(width), return_index=True)
        return zip(used.tolist(), first.tolist(), [*first[1:].tolist(), len(mixed)])

    def word_parts(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The same of sorted hashes of words, whose buckets come behind those of pairs."""
        return ((self.buckets + b, lo, hi) for b, lo, hi in self.parts(words, 63))


@dataclass(frozen=True)
class _Words:
    """Words that aren't held, by sorted hash, with the position of their language's ``_RARE``, and their pairs: of each
    word those it begins, then those it ends (``of``: twice the word's place, one more for the latter), by sorted
    partner (a position, or ``_OTHER`` and a hash)."""

    words: np.ndarray
    homes: np.ndarray
    of: np.ndarray
    partners: np.ndarray
    n: np.ndarray

    def packed(self, lo: int = 0, hi: int | None = None) -> tuple[bytes, bytes, bytes, bytes, bytes]:
        """Those of some words, as the table's columns behind ``bucket``."""
        hi = len(self.words) if hi is None else hi
        a, b = np.searchsorted(self.of, [2 * lo, 2 * hi])
        sizes = np.bincount(self.of[a:b] - 2 * lo, minlength=2 * (hi - lo))
        return _packed(self.partners[a:b]), _packed(self.n[a:b]), _steps(self.words[lo:hi]), _packed(self.homes[lo:hi]), _packed(sizes)

    @classmethod
    def joined(cls, columns: dict[str, list]) -> tuple[_Words, list[int], list[int]]:
        """Of packed rows one behind the other, where neither words nor pairs are in order: behind which words
        and pairs each row ends. ``homes`` and ``n`` may be missing."""
        words, sizes = [_from_steps(x) for x in columns["words"]], [_unpacked(x) for x in columns["sizes"]]
        partners, homes, n = (np.concatenate([np.zeros(0, np.int64), *map(_unpacked, columns.get(c, []))]) for c in ("pairs", "homes", "n"))
        of = np.repeat(np.arange(sum(map(len, sizes))), np.concatenate([np.zeros(0, np.int64), *sizes]))
        ends = np.cumsum([len(x) for x in words]).tolist(), np.cumsum([int(x.sum()) for x in sizes]).tolist()
        return cls(np.concatenate([np.zeros(0, np.int64), *words]), homes, of, partners.view(np.uint64), n), *ends

    def summed(self) -> _Words:
        """In order, each word and pair once."""
        words, at = np.unique(self.words, return_inverse=True)
        homes = np.empty(len(words), np.int64)
        homes[at] = self.homes
        of = 2 * at[self.of >> 1] + (self.of & 1)
        order = np.lexsort((self.partners, of))
        of, partners = of[order], self.partners[order]
        first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (partners[1:] != partners[:-1])])
        return _Words(words, homes, of[first], partners[first], np.add.reduceat(self.n[order], first))

    def figures(self) -> np.ndarray:
        """Of each word its count as a context, the pairs it begins, those counted once and twice, and the pairs it ends."""
        word, begins = self.of >> 1, self.of & 1 == 0
        masks = begins, begins & (self.n == 1), begins & (self.n == 2), ~begins
        counts = np.bincount(word[begins], self.n[begins], len(self.words)).astype(np.int64)
        return np.stack([counts, *(np.bincount(word[m], minlength=len(self.words)) for m in masks)])

    def found(self, asked: _Words) -> tuple[np.ndarray, np.ndarray]:
        """The figures of asked words and the counts of asked pairs, 0 for what isn't there."""
        if not len(self.words):
            return np.zeros((5, len(asked.words)), np.int64), np.zeros(len(asked.of), np.int64)
        word = np.minimum(np.searchsorted(self.words, asked.words), len(self.words) - 1)
        known = self.words[word] == asked.words
        partners, rank = np.unique(self.partners, return_inverse=True)
        key = self.of * len(partners) + rank
        partner = np.minimum(np.searchsorted(partners, asked.partners), len(partners) - 1)
        wanted = (2 * word[asked.of >> 1] + (asked.of & 1)) * len(partners) + partner
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        there = known[asked.of >> 1] & (partners[partner] == asked.partners) & (key[at] == wanted)
        return np.where(known, self.figures()[:, word], 0), np.where(there, self.n[at], 0)


# The model ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Held symbols by sorted hash, with the probability of each by its continuation count, ``_RARE`` with that
    of all words that aren't held; frequent pairs of positions by sorted key, with their counts; each symbol's
    language, its count as a context and the weight of what is below the pairs: of all, and where only the
    frequent ones count; of each language what is taken from continuation counts, their sum and its floor.
    ``rest`` holds the counts of all pairs of held words by buckets, and all other words with their pairs."""

    symbols: np.ndarray
    plain: np.ndarray
    below: np.ndarray
    pairs: np.ndarray
    times: np.ndarray
    of: np.ndarray
    total: np.ndarray
    taken: np.ndarray
    left: np.ndarray
    taken_below: np.ndarray
    sums: np.ndarray
    floor: np.ndarray
    dealt: _Dealt
    rest: DataFrame | None = None

    def ids(self, lang: str, symbols: np.ndarray) -> np.ndarray:
        """Position of every symbol, its inverted hash where it isn't held."""
        return self.places(symbols, ~symbols)[0]

    def places(self, symbols: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of every symbol, that of ``rare`` where it isn't held, and whether it is held."""
        at = np.minimum(np.searchsorted(self.symbols, symbols), len(self.symbols) - 1)
        known = self.symbols[at] == symbols
        return np.where(known, at, rare), known

    def place(self, lang: str, symbol: bytes) -> int:
        return int(np.searchsorted(self.symbols, _hash(symbol, _seed(lang))))

    def held(self, pair: np.ndarray) -> np.ndarray:
        """Counts of frequent pairs, 0 of others."""
        if not len(self.pairs):
            return np.zeros(len(pair), np.int64)
        order = np.argsort(pair)  # neighbours are looked up next to each other
        at = np.empty(len(pair), np.int64)
        at[order] = np.minimum(np.searchsorted(self.pairs, pair[order]), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.times[at], 0)

    def probability(self, before: np.ndarray, after: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        """By the pairs' counts ``n``; without them, by the frequent pairs only."""
        below = self.below if n is None else self.left
        n = self.held((before.astype(np.int64) << 32) | after) if n is None else n
        own = (n - self.taken[self.of[before], np.minimum(n, 3)]) / np.maximum(1, self.total[before])
        return below[before] * self.plain[after] + own

    def probability_beside(self, words: _Words, figures: np.ndarray) -> np.ndarray:
        """Of the pairs of a chain's words that aren't held, whose partners are numbers as in the chain."""
        lang, begins = self.of[words.homes], words.of & 1 == 0
        word, partner = words.of >> 1, words.partners
        count, kinds, once, twice, ended = figures
        lost = (np.stack([once, twice, kinds - once - twice], 1) * self.taken[lang, 1:]).sum(1)
        left = np.where(count > 0, lost / np.maximum(1, count), 1.0)
        plain = (ended - self.taken_below[lang, np.minimum(ended, 3)]) / self.sums[lang] + self.floor[lang]
        total, left, plain = np.r_[self.total, count], np.r_[self.left, left], np.r_[self.plain, plain]
        before, after = (np.where(x, len(self.symbols) + word, partner) for x in (begins, ~begins))
        own = (words.n - self.taken[lang[word], np.minimum(words.n, 3)]) / np.maximum(1, total[before])
        return left[before] * plain[after] + own


def _chain(block: _Block, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position of every word and of the end of every text that has words. Words that aren't held are numbered
    behind all positions, by their sorted hashes; these come along, with the positions of their languages' ``_RARE``."""
    border = np.array([model.place(x, _BORDER) for x in block.langs])
    at = block.each(model.ids)
    there = np.flatnonzero(at < 0)
    others, first, inverse = np.unique(~at[there], return_index=True, return_inverse=True)
    at[there] = len(model.symbols) + inverse
    home = {x: model.place(x, _RARE) for x in dict.fromkeys(block.langs)}
    homes = np.array([home[block.langs[i]] for i in block.rows[there[first]].tolist()], np.int64)
    return np.insert(at, np.cumsum(block.lengths)[block.lengths > 0], border[np.flatnonzero(block.lengths)]), others, homes


def _before(after: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Position before every one of a chain: a text begins with what it ends with."""
    before = np.roll(after, 1)
    steps = lengths[lengths > 0] + 1
    if len(after):
        before[np.cumsum(steps) - steps] = after[np.cumsum(steps) - 1]
    return before


def _others(before: np.ndarray, after: np.ndarray, others: np.ndarray, homes: np.ndarray, size: int, both: bool) -> tuple[_Words, np.ndarray, np.ndarray]:
    """A chain's words that aren't held, with their pairs, whose partners are numbers as in the chain; the places in it
    that these pairs are of, and the pair of each. A pair of two such words counts as one that the first begins;
    with ``both``, also as one that the second ends."""
    begins = before >= size
    first, last = np.flatnonzero(begins), np.flatnonzero((after >= size) & (both | ~begins))
    span = size + len(others)
    key = np.r_[(before[first] - size) * 2 * span + after[first], ((after[last] - size) * 2 + 1) * span + before[last]]
    found, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    return _Words(others, homes, found // span, found % span, n), np.r_[first, last], inverse


def _hashed(words: _Words, size: int) -> _Words:
    """With partners as all blocks know them; their order stays."""
    partners = words.partners.astype(np.uint64)
    far = words.partners >= size
    partners[far] = words.words[words.partners[far] - size].astype(np.uint64) | _OTHER
    return replace(words, partners=partners)


def discounts(n: list[int]) -> np.ndarray:
    """What is taken from counts of 0, 1, 2 and 3 or more, given how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (max(1, x) for x in n)
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0] + [min(max(d, 0.1 * k), 0.95 * k) for k, d in enumerate(found, 1)])


def _per_language(of: np.ndarray, langs: int, *masks: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(of, weights=m, minlength=langs) for m in masks], 1)


def learn(docs: DataFrame, known_most: int = KNOWN_MOST, pairs_most: int = PAIRS_MOST, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> Model | None:
    """Counts of all words and all pairs of words of all documents; None if there is no word."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for lang, _, _, n, symbols in block.by_language():
                found, inverse = np.unique(symbols, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(np.bincount(inverse, n, len(found)).astype(np.int64))], names=["lang", "symbol", "n"])

    counts = written(rows.mapInArrow(words, "lang string, symbol long, n long").groupBy("lang", "symbol").agg(F.sum("n").alias("n")), "symbols", tidy=True)
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    # Each language's share of the held words, by the smallest power of two that keeps to it.
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("level")
    levels = counts.groupBy("lang", level).agg(F.count(F.lit(1)).alias("kinds"))
    upto = F.sum("kinds").over(Window.partitionBy("lang").orderBy(F.desc("level")))
    fits = levels.withColumn("upto", upto).filter(F.col("upto") <= known_most // len(langs)).groupBy("lang").agg(F.min("level").alias("level"))
    kept = counts.join(fits, "lang").filter(F.col("n") >= F.pow(F.lit(2.0), F.col("level"))).select("lang", "symbol").toPandas()
    special = [(x, _hash(s, _seed(x))) for x in langs for s in (_BORDER, _RARE)]
    symbols = np.concatenate([kept["symbol"].to_numpy(np.int64), np.array([s for _, s in special], np.int64)])
    named = {x: i for i, x in enumerate(langs)}
    of = np.concatenate([kept["lang"].map(named).to_numpy(np.int64), np.array([named[x] for x, _ in special], np.int64)])
    order = np.argsort(symbols, kind="stable")
    symbols, of = symbols[order], of[order]
    size = len(symbols)
    none = np.zeros(0)
    dealt = _Dealt(size, 1 + counts.agg(F.sum("n")).first()[0] // BUCKET_WORDS)
    bare = Model(symbols, none, none, none, none, of, none, none, none, none, none, none, dealt)

    shared = spark.sparkContext.broadcast(bare)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            after, others, homes = _chain(block, shared.value)
            before = _before(after, block.lengths)
            held = np.maximum(before, after) < size
            found, n = np.unique(dealt.mixed(before[held], after[held]), return_counts=True)
            rows = [(b, _steps(found[lo:hi]), _packed(n[lo:hi]), None, None, None) for b, lo, hi in dealt.parts(found)]
            words = _hashed(_others(before, after, others, homes, size, both=True)[0], size)
            rows += [(b, *words.packed(lo, hi)) for b, lo, hi in dealt.word_parts(others)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(_KINDS), _KINDS)], names=_COLUMNS)

    def summed(parts: pa.Table) -> pa.Table:
        bucket = parts["bucket"][0].as_py()
        if bucket >= dealt.buckets:
            row = bucket, *_Words.joined(parts.to_pydict())[0].summed().packed()
            return pa.table([pa.array([x], k) for x, k in zip(row, _KINDS)], names=_COLUMNS)
        found, inverse = np.unique(np.concatenate([_from_steps(x) for x in parts["pairs"].to_pylist()]), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([_unpacked(x) for x in parts["n"].to_pylist()]))
        return pa.table([pa.array([x], k) for x, k in zip((bucket, _steps(found), _packed(n), None, None, None), _KINDS)], names=_COLUMNS)

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for found, n in zip(batch["pairs"].to_pylist(), batch["n"].to_pylist()):
                yield dealt.pair(_from_steps(found)), _unpacked(n)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _Words.joined(batch.slice(i, 1).to_pydict())[0]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's sums for each position; those behind stand for the powers of two of the counts.
        out = np.zeros((len(_SUMS), size + 64), np.int64)
        for pair, n in pairs_of(batches):
            context, level = pair >> 32, np.frexp(n.astype(float))[1] - 1
            own = [np.bincount(context, n, size), np.bincount(context, minlength=size)]
            own += [np.bincount(context[n == k], minlength=size) for k in range(1, 5)]
            own.append(np.bincount(pair & ((1 << 32) - 1), minlength=size))
            out[: len(own), :size] += np.array(own).astype(np.int64)
            out[1, size:] += np.bincount(level, minlength=64)
        yield some(out)

    def word_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The same of words that aren't held and their pairs; what pairs such a word begins stands at ``_RARE``.
        out = np.zeros((len(_SUMS), size), np.int64)
        for words in words_of(batches):
            begins, held = words.of & 1 == 0, words.partners < _OTHER
            home, partner = words.homes[words.of >> 1], words.partners.astype(np.int64)
            out[6] += np.bincount(partner[begins & held], minlength=size)
            context = np.where(begins, home, partner)
            for k in range(1, 5):
                out[1 + k] += np.bincount(context[(begins | held) & (words.n == k)], minlength=size)
            ended = ~begins & held
            out[0] += np.bincount(partner[ended], words.n[ended], size).astype(np.int64)
            out[1] += np.bincount(partner[ended], minlength=size)
            ends = words.figures()[4]
            out[6] += np.bincount(words.homes, ends, size).astype(np.int64)
            out[7] += np.bincount(words.homes, minlength=size)
            for k in range(1, 5):
                out[7 + k] += np.bincount(words.homes[ends == k], minlength=size)
        yield some(out)

    def some(out: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(out.any(0))
        return pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at]) for x in out)], names=["at", *_SUMS])

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, n in pairs_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(pair[n >= least]), pa.array(n[n >= least])], names=["pair", "n"])

    schema = "bucket long, " + ", ".join(f"{c} binary" for c in _COLUMNS[1:])
    rest = written(rows.mapInArrow(pairs, schema).groupBy("bucket").applyInArrow(summed, schema), "pairs", tidy=True)
    held, others = rest.filter("words IS NULL"), rest.filter("words IS NOT NULL")
    longs = ", ".join(f"{c} long" for c in ["at", *_SUMS])
    found = held.mapInArrow(sums, longs).unionByName(others.mapInArrow(word_sums, longs)).groupBy("at").agg(*(F.sum(c).alias(c) for c in _SUMS)).toPandas()
    contexts, levels = found[found["at"] < size], found[found["at"] >= size]
    least = least_of(dict(zip((levels["at"] - size).tolist(), levels["kinds"].tolist())), pairs_most)
    often = held.mapInArrow(frequent, "pair long, n long").toArrow().sort_by("pair")

    def spread(column):
        out = np.zeros(size)
        out[contexts["at"].to_numpy(np.int64)] = contexts[column].to_numpy(float)
        return out

    total = spread("n")
    taken = np.stack([discounts(n.tolist()) for n in _per_language(of, len(langs), *(spread(f"n{k}") for k in range(1, 5)))])
    # A language's words that aren't held stand together at its ``_RARE``, each with its own discount.
    continuations, many = spread("before"), spread("words")
    few = [spread(f"b{k}") for k in range(1, 5)]
    own = np.where(many > 0, 0, continuations)
    taken_below = np.stack([discounts(n.tolist()) for n in _per_language(of, len(langs), *((own == k) + x for k, x in enumerate(few, 1)))])
    # A symbol that nothing precedes (a word that no text has) still gets the uniform floor.
    less = taken_below[of, np.minimum(own, 3).astype(int)] + (np.stack([few[0], few[1], many - few[0] - few[1]], 1) * taken_below[of, 1:]).sum(1)
    sums = np.maximum(1.0, np.bincount(of, weights=continuations, minlength=len(langs)))
    floor = np.bincount(of, weights=less, minlength=len(langs)) / sums / np.bincount(of, weights=1 + many, minlength=len(langs))
    plain = (continuations - less) / sums[of] + floor[of] * (1 + many)

    # What is taken from all pairs of a context goes to what is below them.
    once, twice = spread("n1"), spread("n2")
    lost = np.stack([once, twice, spread("kinds") - once - twice], 1)
    left = np.where(total > 0, (lost * taken[of, 1:]).sum(1) / np.maximum(1.0, total), 1.0)

    pair, n = often["pair"].to_numpy(), often["n"].to_numpy()
    context = pair >> 32
    above = (n - taken[of[context], np.minimum(n, 3)]) / total[context]
    below = np.maximum(1.0 - np.bincount(context, weights=above, minlength=size), 0.0)
    return Model(symbols, plain, below, pair, n, of, total, taken, left, taken_below, sums, floor, dealt, rest)


# The rules ---------------------------------------------------------------------------------


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _lacking(model: Model, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pairs of held words of a block's chain, as dealt; where they are in it, and the pair of each; frequent
    ones' counts."""
    at = np.flatnonzero(np.maximum(before, after) < len(model.symbols))
    found, inverse = np.unique(model.dealt.mixed(before[at], after[at]), return_inverse=True)
    return found, at, inverse, model.held(model.dealt.pair(found))


def _places(kinds: bytes, places: bytes) -> np.ndarray:
    return _unpacked(kinds)[_unpacked(places)]


def statistics(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and log_perplexity
    (log10, for each word and the end; null without words) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model and replace(model, rest=None))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    arrays = ["doc_id", "lang", *_COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            chars, signs, lines = [], [], []
            for text in block.texts:
                text = text or b""
                chars.append(len(text.translate(None, _BLANK + _INNER)))
                signs.append(len(text) - len(text.translate(None, _SYMBOLS)))
                full = [x for x in text.split(b"\n") if x and not x.isspace()]
                lines.append(len(full) - len(set(full)))
            after, others, homes = _chain(block, shared.value) if shared.value is not None else [np.zeros(0, np.int64)] * 3
            n = np.bincount(after, minlength=1)
            kinds = np.flatnonzero(n)
            kinds = kinds[np.argsort(-n[kinds], kind="stable")]
            place = np.zeros(len(n), np.int64)
            place[kinds] = np.arange(len(kinds))
            columns = [block.doc_ids, block.langs, block.lengths, chars, signs, lines, block.repeated()]
            types = [pa.int64(), pa.string(), *[pa.int64()] * 5]
            held = [pa.array([uuid.uuid4().hex])] + [pa.array([c], pa.list_(k)) for c, k in zip(columns, types)]
            held += [pa.array([x], pa.binary()) for x in (_packed(kinds), _packed(place[after]), _packed(homes), _steps(others))]
            yield pa.RecordBatch.from_arrays(held, names=["block", *arrays, "kinds", "places", "homes", "words"])

    longs = ", ".join(f"{c} array<long>" for c in _COUNTS)
    # Blocks are written, as they must be the same ones when they ask and when they are answered.
    def blocks(part: DataFrame) -> DataFrame:
        return written(part.mapInArrow(run, f"block string, doc_id array<long>, lang array<string>, {longs}, kinds binary, places binary, homes binary, words binary"), "blocks")

    if model is None:
        each = blocks(rows).select(F.explode(F.arrays_zip(*arrays)).alias("row")).select("row.*")
        return each.withColumn("log_perplexity", F.lit(None).cast("double"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for block, lengths, kinds, places, words in zip(*(batch[c].to_pylist() for c in ("block", "n_words", "kinds", "places", "words"))):
                after, others = _places(kinds, places), _from_steps(words)
                before = _before(after, np.array(lengths, np.int64))
                found, _, _, n = _lacking(model, before, after)
                found = found[n == 0]
                parts = [(b, block, _steps(found[lo:hi]), None, None) for b, lo, hi in model.dealt.parts(found)]
                beside = _hashed(_others(before, after, others, np.zeros(0, np.int64), len(model.symbols), both=False)[0], len(model.symbols))
                for b, lo, hi in model.dealt.word_parts(others):
                    pairs, _, some, _, sizes = beside.packed(lo, hi)
                    parts.append((b, block, pairs, some, sizes))
                if parts:
                    kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts), kinds)], names=["bucket", "block", "pairs", "words", "sizes"])

    def answered(asking: pa.Table, counted: pa.Table) -> pa.Table:
        answers, figures = [], [None] * asking.num_rows
        if asking.num_rows and asking["words"][0].is_valid:
            there = _Words.joined(counted.to_pydict())[0]
            asked, words, pairs = _Words.joined(asking.select(["pairs", "words", "sizes"]).to_pydict())
            told, n = there.found(asked)
            answers = [_packed(x) for x in np.split(n, pairs[:-1])]
            figures = [_packed(x.ravel()) for x in np.split(told, words[:-1], axis=1)]
        else:
            found, n = np.full(1, -1), np.zeros(1, np.int64)
            if counted.num_rows:
                found, n = _from_steps(counted["pairs"][0].as_py()), _unpacked(counted["n"][0].as_py())
            for pairs in map(_from_steps, asking["pairs"].to_pylist()):
                at = np.minimum(np.searchsorted(found, pairs), len(found) - 1)
                answers.append(_packed(np.where(found[at] == pairs, n[at], 0)))
        return pa.table({"bucket": asking["bucket"], "block": asking["block"], "n": pa.array(answers, pa.binary()), "figures": pa.array(figures, pa.binary())})

    def scored(block: pa.Table, answers: pa.Table) -> pa.Table:
        model, row = shared.value, {c: block[c][0].as_py() for c in block.column_names}
        lengths, after, homes = np.array(row["n_words"], np.int64), _places(row["kinds"], row["places"]), _unpacked(row["homes"])
        before = _before(after, lengths)
        told = sorted(zip(*(answers[c].to_pylist() for c in ("bucket", "n", "figures"))))
        counts, beside = ([x for x in told if (x[2] is not None) == y] for y in (False, True))
        found, at, inverse, n = _lacking(model, before, after)
        if counts:
            n[n == 0] = np.concatenate([_unpacked(x) for _, x, _ in counts])
        pair = model.dealt.pair(found)
        p = np.empty(len(after))
        p[at] = np.log10(model.probability(pair >> 32, pair & ((1 << 32) - 1), n))[inverse]
        if beside:
            # Hashes aren't needed: the block's words and pairs are in the order of what was asked.
            words, at, inverse = _others(before, after, homes, homes, len(model.symbols), both=False)
            words = replace(words, n=np.concatenate([_unpacked(x) for _, x, _ in beside]))
            figures = np.concatenate([_unpacked(x).reshape(5, -1) for _, _, x in beside], axis=1)
            p[at] = np.log10(model.probability_beside(words, figures))[inverse]
        of = np.repeat(np.arange(len(lengths)), np.where(lengths > 0, lengths + 1, 0))
        total = np.bincount(of, weights=p, minlength=len(lengths)).tolist()
        score = [-t / (k + 1) if k else None for t, k in zip(total, lengths.tolist())]
        return pa.table({**{c: pa.array(row[c], pa.string() if c == "lang" else pa.int64()) for c in arrays}, "log_perplexity": pa.array(score, pa.float64())})

    def measured(part: DataFrame) -> DataFrame:
        held = blocks(part)
        asking = held.select("block", "n_words", "kinds", "places", "words").mapInArrow(asked, "bucket long, block string, pairs binary, words binary, sizes binary")
        answers = asking.groupBy("bucket").cogroup(model.rest.groupBy("bucket")).applyInArrow(answered, "bucket long, block string, n binary, figures binary")
        flat = ", ".join(f"{c} long" for c in _COUNTS)
        found = held.drop("words").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, f"doc_id long, lang string, {flat}, log_perplexity double")
        found = written(found, "measured", tidy=True)
        dropped(held)
        return found

    rounds = min(ROUNDS, model.dealt.buckets)
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(rounds))
    return reduce(DataFrame.unionByName, [measured(rows.filter(turn == i)) for i in range(rounds)])


def bands(measured: DataFrame, below: float = BELOW, above: float = ABOVE, least: int = BAND_LEAST) -> DataFrame:
    """lang, low, high: log perplexities that a language's documents may have."""
    points = F.percentile_approx("log_perplexity", F.array(*map(F.lit, (0.01, 0.5, 0.99))), F.lit(10_000)).alias("q")
    found = measured.groupBy("lang").agg(points, F.count("log_perplexity").alias("held")).filter(F.col("held") >= least)
    low, middle, high = (F.element_at("q", i) for i in (1, 2, 3))
    return found.select("lang", (middle - below * (middle - low)).alias("low"), (middle + above * (high - middle)).alias("high"))


def judge(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", lang: str = "lang", text: str = "text", **limits) -> DataFrame:
    """doc_id, the counts, base_failed, log_perplexity, low, high and kept of every row.

    A text fails the base rules with fewer than 50 words or if more than half of them stand in repeated
    windows of three. Else it is kept if its perplexity lies in the band of its language, or if its
    language has too few documents for one. A null text counts as empty and a null language as
    ``und``; repeated rows and ids are judged each, and count each; a null id stays null. On a bound
    is inside. An empty table gives no rows. Texts are read whole; other columns aren't looked at.
    """
    measured = statistics(docs, model, doc_id, lang, text)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    joined = measured.join(bands(measured.filter("NOT base_failed"), **limits), "lang", "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop("lang")
