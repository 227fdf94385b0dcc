"""Log-bilinear language model, trained in numpy by noise-contrastive estimation.

Every known word has a vector as a word before another (one for each of the two places) and as a
word that comes. A word is predicted in three steps, each from the vectors of the two words before
it: its symbol, the group inside the symbol, the word inside the group. Frequent words are symbols
of their own, other known words share one by frequency, and all rare words share one; groups hold
words whose vectors are alike. Each step is normalised over its own choices only.

The symbols' table over pairs of symbols is fitted first, and the vectors learn what it leaves.
They are trained on counts of runs of three words, which Spark tasks gather from all training
documents and deal out by the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, least_count, mapped, numbered_words, partitions, written

HELD_OUT_MOD, HELD_OUT = 7, 2
#: Words whose counts and symbols every task knows, at most; they are broadcast. All other words
#: are counted, looked up and scored by a join.
KNOWN_WORDS = 100_000
#: Words with a symbol of their own, and symbols for the other known words.
SINGLE, BANDS = 64, 30
RARE, START = SINGLE + BANDS, SINGLE + BANDS + 1
SYMBOLS = SINGLE + BANDS + 2
DIMENSIONS, NOISE, STEPS, RATE = 24, 10, 150, 0.05
#: Of the words' vectors: their length, drawn words, rate, passes over the counts, runs of three
#: words that are worked on at a time and in one product, and rows that travel together.
WIDTH, DRAWN, WORD_RATE, ROUNDS, AT_ONCE, IN_CACHE, BLOCK = 16, 10, 0.1, 2, 1 << 17, 2048, 4096
#: Runs that are scored at a time, and shares of the runs that a pass of training starts alike and averages.
SCORED, SHARES = 1 << 19, 48
#: Tokens whose runs a task sums before it hands them on, and bits of a word's number in a run.
HELD_TOKENS, BITS = 1 << 20, 20
#: The token after the last word; no word is empty. Bytes of text that are split at one time.
END, PART = b"", 4 << 20


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, as bytes, and the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def tokens_of(texts: list[bytes | None], parts: int = 1) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """``words_of`` some texts at a time: the distinct words, the end as the last one; the number of every
    token; how many each text has."""
    held: list[bytes] = []
    size = 0
    for at, text in enumerate(texts, 1):
        held.append((text or b"").lower())
        size += len(held[-1])
        if size >= parts * PART or at == len(texts):
            words, ids, lengths = numbered_words(held)
            yield [*words, END], np.insert(ids.astype(np.int64), np.cumsum(lengths), len(words)), lengths + 1
            held, size = [], 0


class Lexicon:
    """Known words with their counts, most frequent first, and what the others add up to."""

    def __init__(self, words: list[bytes], counts: np.ndarray, tokens: int, kinds: int):
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.words, self.counts = [words[i] for i in order], np.asarray(counts, np.int64)[order]
        self.tokens, self.kinds = tokens, kinds
        self.rare_tokens, self.rare_kinds = tokens - int(self.counts.sum()), kinds - len(words)
        single = self.counts[:SINGLE].sum()
        mass = (np.cumsum(self.counts) - single) / max(1, self.counts.sum() - single)
        band = SINGLE + np.minimum(BANDS - 1, (mass * BANDS).astype(int))
        place = np.arange(len(words))
        # One more entry, the last, stands for every word that isn't known.
        self.symbol = np.r_[np.where(place < SINGLE, place, band), RARE].astype(np.int64)
        share = np.bincount(self.symbol[:-1], self.counts, SYMBOLS)
        self.log_share = np.r_[np.log10(self.counts / share[self.symbol[:-1]]), 0.0]
        self.log_count = np.r_[np.log10(self.counts + 1), 0.0]

    def index(self) -> dict[bytes, int]:
        return dict(zip(self.words, range(len(self.words))))

    def run_symbol(self) -> np.ndarray:
        """Symbol of a word's number in a run, where two more stand for rare words and the start."""
        return np.r_[self.symbol, START]


def contexts(symbols: np.ndarray) -> np.ndarray:
    """Cell of (symbol two before, symbol before) of each token of a document."""
    padded = np.r_[START, START, symbols[:-1]] if len(symbols) else symbols
    return padded[: len(symbols)] * SYMBOLS + padded[1 : len(symbols) + 1]


def fit(cells: np.ndarray, counts: np.ndarray, steps: int = STEPS, seed: int = 7) -> np.ndarray:
    """log10 P(symbol | two symbols before), [context, symbol], from counts of (context, symbol).

    The score of a symbol is bilinear in its vector and a linear image of the vectors before it.
    Training tells the counted symbols from ``NOISE`` times as many drawn by their overall
    frequency; as every symbol of a context is scored at once, the noise enters by its
    expectation. The scores of all contexts are matrix products, and are normalised exactly.
    """
    rng = np.random.default_rng(seed)
    data = np.zeros((SYMBOLS * SYMBOLS, SYMBOLS))
    data.ravel()[cells] = counts
    noise = data.sum(0) + 0.5
    noise[START] = 1e-3
    noise /= noise.sum()
    seen = np.flatnonzero(data.sum(1))
    rows = data[seen] / max(1.0, data.sum())
    two, one = seen // SYMBOLS, seen % SYMBOLS
    of_two, of_one = np.eye(SYMBOLS)[two], np.eye(SYMBOLS)[one]
    drawn = NOISE * rows.sum(1)[:, None] * noise
    p = {
        "before": rng.normal(0, 0.1, (SYMBOLS, DIMENSIONS)), "two": np.eye(DIMENSIONS) * 0.5, "one": np.eye(DIMENSIONS),
        "after": rng.normal(0, 0.1, (SYMBOLS, DIMENSIONS)), "bias": np.log(noise),
    }
    mean, square = {k: 0.0 for k in p}, {k: 0.0 for k in p}
    for step in range(1, steps + 1 if len(seen) else 1):
        left, right = p["before"] @ p["two"], p["before"] @ p["one"]
        context = left[two] + right[one]
        odds = context @ p["after"].T + p["bias"] - np.log(NOISE * noise)
        real = 1 / (1 + np.exp(-odds))
        slope = rows * (1 - real) - drawn * real
        back = slope @ p["after"]
        by_two, by_one = of_two.T @ back, of_one.T @ back
        up = {
            "before": by_two @ p["two"].T + by_one @ p["one"].T, "two": p["before"].T @ by_two, "one": p["before"].T @ by_one,
            "after": slope.T @ context, "bias": slope.sum(0),
        }
        for k, g in up.items():
            mean[k], square[k] = 0.9 * mean[k] + 0.1 * g, 0.99 * square[k] + 0.01 * g * g
            p[k] = p[k] + RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-9)
    left, right = p["before"] @ p["two"], p["before"] @ p["one"]
    score = ((left @ p["after"].T)[:, None, :] + (right @ p["after"].T)[None, :, :] + p["bias"]).reshape(-1, SYMBOLS)
    score[:, START] = -np.inf  # nothing is followed by the start
    top = score.max(1, keepdims=True)
    return (score - top - np.log(np.exp(score - top).sum(1, keepdims=True))) / np.log(10)


def _word_counts(train: DataFrame) -> DataFrame:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, ids, _ in tokens_of(batch.column(0).cast(pa.binary()).to_pylist(), 4):
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.bincount(ids, minlength=len(words)).astype(np.int64))], names=["word", "n"])

    rows = train.select("text").mapInArrow(counted, "word binary, n long")
    return written(rows.groupBy("word").agg(F.sum("n").alias("n")), "words")


def runs_of(at: np.ndarray, lengths: np.ndarray, known: int) -> np.ndarray:
    """Runs of three words of documents of ``lengths`` tokens, each as one number; ``at`` has -1 for a rare word."""
    at = np.where(at < 0, known, at)
    starts = np.cumsum(lengths) - lengths
    one, two = np.roll(at, 1), np.roll(at, 2)
    one[starts] = known + 1
    two[starts] = known + 1
    two[starts[lengths > 1] + 1] = known + 1
    return two << 2 * BITS | one << BITS | at


def _known(words: list[bytes], index: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((index.get(w, -1) for w in words), np.int64, len(words))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(n[order], starts) if len(keys) else n


_PACKED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])


def _packed(bucket: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Keys as steps from one to the next, counts in as few bytes as the largest takes."""
    steps = np.diff(keys, prepend=0).astype(np.int64)
    return pa.RecordBatch.from_pydict({"bucket": [bucket], "keys": [steps.tobytes()], "n": [n.astype(np.min_scalar_type(n.max())).tobytes()]}, _PACKED)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for keys, n in zip(batch.column("keys").to_pylist(), batch.column("n").to_pylist()):
        yield np.cumsum(np.frombuffer(keys, np.int64)), np.frombuffer(n, f"u{8 * len(n) // len(keys)}").astype(np.int64)


def _together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed rows put together until they hold ``size`` runs."""
    held: list[tuple] = []
    count = 0
    for batch in batches:
        for pair in _unpacked(batch):
            held.append(pair)
            count += len(pair[0])
            if count >= size:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, count = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def run_counts(train: DataFrame, lexicon) -> DataFrame:
    """Counts of all runs of three words, as packed rows; a run is in one partition only."""
    parts = partitions(train.sparkSession)
    buckets = 4 * parts

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        index, size = known.index(), len(known.words)
        held: list[np.ndarray] = []
        tokens = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys = np.sort(np.concatenate(held))
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, n = keys[starts], np.diff(np.r_[starts, len(keys)])
            bucket = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
            # Short numbers are sorted by their bytes.
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(bounds)):
                own = order[bounds[b] : bounds[b + 1]]
                yield _packed(int(b), keys[own], n[own])

        for batch in batches:
            for words, ids, lengths in tokens_of(batch.column(0).cast(pa.binary()).to_pylist()):
                held.append(runs_of(_known(words, index)[ids], lengths, size))
                tokens += len(ids)
                if tokens >= HELD_TOKENS:
                    yield from out()
                    held, tokens = [], 0
        if tokens:
            yield from out()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [p for batch in batches for p in _unpacked(batch)]
        if pairs:
            keys, n = _summed(np.concatenate([k for k, _ in pairs]), np.concatenate([n for _, n in pairs]))
            # In an order of chance, so that what is worked on at a time is a fair part of all.
            place = np.random.default_rng(len(keys)).integers(max(1, -(-len(keys) // (AT_ONCE // 2))), size=len(keys))
            for i in np.unique(place).tolist():
                own = np.flatnonzero(place == i)
                yield _packed(i, keys[own], n[own])

    schema = "bucket int, keys binary, n binary"
    return written(train.select("text").mapInArrow(counted, schema).repartition(parts, "bucket").mapInArrow(merged, schema), "runs")


def _cell_counts(runs: DataFrame, lexicon) -> pd.DataFrame:
    """Counts of runs of three symbols; there are at most SYMBOLS^3, whatever the input."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = lexicon.value.run_symbol()
        total, mask = np.zeros(SYMBOLS**3), (1 << BITS) - 1
        for keys, n in _together(batches, HELD_TOKENS):
            cells = (symbol.take(keys >> 2 * BITS) * SYMBOLS + symbol.take(keys >> BITS & mask)) * SYMBOLS + symbol.take(keys & mask)
            total += np.bincount(cells, n, SYMBOLS**3)
        cells = np.flatnonzero(total)
        bounds = np.searchsorted(cells, np.arange(SYMBOLS + 1) * SYMBOLS**2)
        for b in np.flatnonzero(np.diff(bounds)):
            own = cells[bounds[b] : bounds[b + 1]]
            yield _packed(int(b), own, total[own].astype(np.int64))

    def added(of: pa.Table) -> pa.Table:
        cells, n = zip(*(p for batch in of.to_batches() for p in _unpacked(batch)))
        cells, n = _summed(np.concatenate(cells), np.concatenate(n))
        return pa.table({"cell": cells.astype(np.int32), "n": n})

    rows = runs.mapInArrow(counted, "bucket int, keys binary, n binary").groupBy("bucket").applyInArrow(added, "cell int, n long")
    return rows.toPandas().sort_values("cell")


class Groups:
    """Groups of words inside symbols. Words stand in an order in which a group's, and a symbol's
    groups, are neighbours; what a word or group has of its parent's count is its share."""

    def __init__(self, lexicon: Lexicon, groups: list[np.ndarray]):
        self.symbol = lexicon.symbol[:-1]
        grouped = [g for g in groups if len(g)]
        self.words = np.concatenate(grouped) if grouped else np.zeros(0, np.int64)
        self.starts = np.r_[0, np.cumsum([len(g) for g in grouped])].astype(np.int64)
        self.place = np.full(len(lexicon.words) + 2, -1)
        self.place[self.words] = np.arange(len(self.words))
        self.group = np.repeat(np.arange(len(grouped)), np.diff(self.starts))
        counts = lexicon.counts[self.words].astype(float)
        mass = np.add.reduceat(counts, self.starts[:-1]) if grouped else np.zeros(0)
        self.parent = self.symbol[self.words[self.starts[:-1]]] if grouped else np.zeros(0, np.int64)
        of_symbol = np.bincount(self.parent, mass, SYMBOLS)
        self.word_share = np.log(counts / mass[self.group]).astype(np.float32)
        self.group_share = np.log(mass / of_symbol[self.parent]).astype(np.float32)
        self.group_starts = np.searchsorted(self.parent, np.arange(SYMBOLS + 1))
        self.word_sums, self.group_sums = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(mass)]


def bands(lexicon: Lexicon) -> Groups:
    """One group for every symbol that has several words."""
    order = np.argsort(lexicon.symbol[:-1], kind="stable")
    bounds = np.searchsorted(lexicon.symbol[:-1][order], np.arange(SINGLE, RARE + 1))
    return Groups(lexicon, [order[a:b] for a, b in zip(bounds[:-1], bounds[1:])])


def halved(words: np.ndarray, vectors: np.ndarray, most: int) -> list[np.ndarray]:
    """Parts of at most ``most`` words; each cut is across the direction in which vectors differ most."""
    if len(words) <= most:
        return [words]
    own = vectors[words] - vectors[words].mean(0)
    along = own @ np.linalg.eigh(own.T @ own)[1][:, -1]
    order = words[np.argsort(along, kind="stable")]
    return halved(order[: len(order) // 2], vectors, most) + halved(order[len(order) // 2 :], vectors, most)


def regrouped(lexicon: Lexicon, old: Groups, p: dict[str, np.ndarray]) -> tuple[Groups, dict[str, np.ndarray]]:
    """Groups of about as many words as a symbol has groups; their vectors start at their words' mean."""
    vectors = np.zeros((len(lexicon.words), WIDTH), np.float32)
    vectors[old.words] = p["word"]
    parts = [g for a, b in zip(old.starts[:-1], old.starts[1:]) for g in halved(old.words[a:b], vectors, max(8, int((b - a) ** 0.5)))]
    new = Groups(lexicon, parts)
    share = np.exp(new.word_share)[:, None]
    mean = np.add.reduceat(share * vectors[new.words], new.starts[:-1]) if len(parts) else np.zeros((0, WIDTH))
    return new, p | {"group": mean.astype(np.float32), "word": (vectors[new.words] - mean[new.group]).astype(np.float32)}


def started(lexicon: Lexicon, groups: Groups, seed: int = 7) -> dict[str, np.ndarray]:
    """Vectors of the words before are drawn; all others are zero, at which the symbols' table and shares hold."""
    rng = np.random.default_rng(seed)
    sizes = {"one": len(lexicon.words) + 2, "two": len(lexicon.words) + 2, "symbol": SYMBOLS, "group": len(groups.parent), "word": len(groups.words)}
    return {k: (rng.normal(0, 0.3, (n, WIDTH)) if k in ("one", "two") else np.zeros((n, WIDTH))).astype(np.float32) for k, n in sizes.items()}


def _sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; two numbers are added at a time, as the parts of a complex one."""
    return np.add.reduceat(rows.view(np.complex64), starts).view(np.float32)


def _rows(at: np.ndarray, rows: np.ndarray, ordered: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of each number in ``at``."""
    if not ordered:
        order = np.argsort(at)
        at, rows = at[order], rows.take(order, axis=0)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[starts], _sums(rows, starts)


def _drawn_below(up: dict, p: dict, kind: str, child: np.ndarray, parent: np.ndarray, starts: np.ndarray, sums: np.ndarray, context: np.ndarray, back: np.ndarray, n: np.ndarray, rng) -> None:
    """One step of the estimation among the children of a parent; rows are in order of the child.

    Each parent's noise is drawn from its children by their counts, which also are the model's
    score at a vector of zero, so the odds are the bilinear part alone. A parent's rows stand in
    pieces of one length, the last filled up with rows that count 0, so that one product serves
    all parents. Where no parent has two children there is nothing to tell apart."""
    if not len(child) or np.diff(starts).max() < 2:
        return
    vectors, log_k = p[kind], np.float32(np.log(DRAWN))
    begins = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
    ends, of = np.r_[begins[1:], len(parent)], parent[begins]
    low, high = sums[starts[of]], sums[starts[of + 1]]
    noise = np.searchsorted(sums, low[:, None] + rng.random((len(of), DRAWN)) * (high - low)[:, None], "right") - 1
    noise = np.clip(noise, starts[of][:, None], starts[of + 1][:, None] - 1)
    length = 1 << int(np.clip(np.log2(len(parent) / len(of)) - 1, 3, 9))
    cuts = np.unique(np.searchsorted(begins, np.arange(0, len(parent), IN_CACHE), "right") - 1)
    for i, j in zip(cuts, [*cuts[1:], len(of)]):
        at = slice(begins[i], ends[j - 1])
        rows, own, weights = context[at], vectors.take(child[at], axis=0), n[at]
        real = weights / (1 + np.exp(np.minimum(np.einsum("ij,ij->i", rows, own) - log_k, 30)))
        own *= real[:, None]
        up[kind].append(_rows(child[at], real[:, None] * rows, ordered=True))
        sizes = ends[i:j] - begins[i:j]
        pieces = -(-sizes // length)
        first = np.cumsum(pieces) - pieces
        place = np.arange(len(rows)) + np.repeat(first * length - begins[i:j] + begins[i], sizes)
        filled, counted = np.zeros((pieces.sum(), length, WIDTH), np.float32), np.zeros((pieces.sum(), length, 1), np.float32)
        filled.reshape(-1, WIDTH)[place], counted.ravel()[place] = rows, weights
        drawn = vectors.take(np.repeat(noise[i:j], pieces, axis=0), axis=0)
        slope = -counted / (1 + np.exp(np.minimum(log_k - filled @ drawn.transpose(0, 2, 1), 30)))
        own += (slope @ drawn).reshape(-1, WIDTH).take(place, axis=0)
        back[at] += own
        up[kind].append((noise[i:j].ravel(), _sums(slope.transpose(0, 2, 1) @ filled, first).reshape(-1, WIDTH)))


def step(p: dict, square: dict, groups: Groups, symbol: np.ndarray, table: np.ndarray, noise: np.ndarray, keys: np.ndarray, n: np.ndarray, rng) -> None:
    """One step on some runs: their words against drawn symbols, groups and words; changes ``p`` and ``square``."""
    mask = (1 << BITS) - 1
    last = keys & mask
    # In the order symbol, group, word: rows of one parent are neighbours in every step.
    order = np.argsort(symbol[last] * len(groups.place) + groups.place[last])
    keys, n, last = keys[order], n[order].astype(np.float32), last[order]
    two, one, own = keys >> 2 * BITS, keys >> BITS & mask, symbol[last]
    context = p["one"].take(one, axis=0)
    context += p["two"].take(two, axis=0)
    back = np.zeros_like(context)
    up: dict[str, list] = {k: [] for k in p}

    drawn = rng.choice(SYMBOLS, DRAWN, p=noise)
    against = np.log(DRAWN * noise).astype(np.float32)
    others, flat = p["symbol"][drawn], table.ravel()
    for i in range(0, len(keys), IN_CACHE):
        at = slice(i, i + IN_CACHE)
        rows, sym, cell = context[at], own[at], (symbol[two[at]] * SYMBOLS + symbol[one[at]]) * SYMBOLS
        mine = p["symbol"].take(sym, axis=0)
        real = n[at] / (1 + np.exp(np.minimum(np.einsum("ij,ij->i", rows, mine) + flat[cell + sym] - against[sym], 30)))
        false = -n[at, None] / (1 + np.exp(np.minimum(against[drawn] - rows @ others.T - flat[cell[:, None] + drawn], 30)))
        back[at] = real[:, None] * mine + false @ others
        up["symbol"] += [_rows(sym, real[:, None] * rows, ordered=True), (drawn, false.T @ rows)]

    a, b = np.searchsorted(own, [SINGLE, RARE])
    place = groups.place[last[a:b]]
    group = groups.group[place]
    _drawn_below(up, p, "group", group, own[a:b], groups.group_starts, groups.group_sums, context[a:b], back[a:b], n[a:b], rng)
    _drawn_below(up, p, "word", place, group, groups.starts, groups.word_sums, context[a:b], back[a:b], n[a:b], rng)
    up["one"].append((one, back))
    up["two"].append((two, back))
    for k, parts in up.items():
        if parts:
            at, g = _rows(*parts[0]) if len(parts) == 1 else _rows(np.concatenate([a for a, _ in parts]), np.concatenate([g for _, g in parts]))
            squares = square[k].take(at, axis=0)
            squares += g * g
            square[k][at] = squares
            p[k][at] += WORD_RATE * g / np.sqrt(squares)


def trained(runs: DataFrame, lexicon: Lexicon, groups: Groups, p: dict[str, np.ndarray], table: np.ndarray, tokens: int, turn: int) -> dict[str, np.ndarray]:
    """``p`` after a pass over all runs: every task starts at ``p`` and goes through its own share;
    a row moves by the mean of its moves over the tasks that moved it."""
    spark = runs.sparkSession
    tasks = max(1, min(SHARES, runs.rdd.getNumPartitions()))
    at_once = int(np.clip(tokens // (64 * tasks), 1024, AT_ONCE))
    noise = np.bincount(lexicon.symbol[:-1], lexicon.counts, SYMBOLS) + 0.5
    noise[RARE] += lexicon.rare_tokens
    noise[START] = 1e-3
    shared = spark.sparkContext.broadcast((lexicon.run_symbol(), groups, p, (table * np.log(10)).astype(np.float32), noise / noise.sum()))
    arrow = pa.schema([("kind", pa.string()), ("block", pa.int32()), ("moved", pa.binary()), ("by", pa.binary())])

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, groups, first, table, noise = shared.value
        own, square = {k: v.copy() for k, v in first.items()}, {k: np.ones_like(v) for k, v in first.items()}
        rng = np.random.default_rng(turn)
        for keys, n in _together(batches, at_once):
            order = rng.permutation(len(keys)) if len(keys) > at_once else np.arange(len(keys))
            for i in range(0, len(keys), at_once):
                step(own, square, groups, symbol, table, noise, keys[order[i : i + at_once]], n[order[i : i + at_once]], rng)
        for k in own:
            for at in range(0, len(own[k]), BLOCK):
                moved = own[k][at : at + BLOCK] - first[k][at : at + BLOCK]
                if moved.any():
                    yield pa.RecordBatch.from_pydict({"kind": [k], "block": [at], "moved": [moved.tobytes()], "by": [moved.any(1).astype(np.int64).tobytes()]}, arrow)

    def added(of: pa.Table) -> pa.Table:
        moved = sum(np.frombuffer(x, np.float32).astype(float) for x in of["moved"].to_pylist()).reshape(-1, WIDTH)
        by = np.maximum(1, sum(np.frombuffer(x, np.int64) for x in of["by"].to_pylist()))
        mean = moved / by[:, None]
        return pa.table({"kind": of["kind"][:1], "block": of["block"][:1], "moved": [mean.astype(np.float32).tobytes()], "by": [b""]}, schema=arrow)

    schema = "kind string, block int, moved binary, by binary"
    rows = runs.coalesce(tasks).mapInArrow(worked, schema).groupBy("kind", "block").applyInArrow(added, schema).select("kind", "block", "moved").toArrow()
    after = {k: v.copy() for k, v in p.items()}
    for kind, block, moved in zip(*(rows[c].to_pylist() for c in ("kind", "block", "moved"))):
        after[kind][block : block + BLOCK] += np.frombuffer(moved, np.float32).reshape(-1, WIDTH)
    shared.destroy()
    return after


def _log_sums(x: np.ndarray, apart: float) -> np.ndarray:
    """ln of the sums of exp(x), which is changed. Where ``x`` is at most ``apart`` from ln of shares that
    add up to one, and that is little, no sum leaves the range of its numbers."""
    if apart < 60:
        return np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype))
    top = x.max(1)
    x -= top[:, None]
    return top + np.log(np.exp(x, out=x).sum(1))


def log_chances(keys: np.ndarray, symbol: np.ndarray, groups: Groups, p: dict[str, np.ndarray], table: np.ndarray) -> np.ndarray:
    """ln P(last word | the two before) of runs; of a rare word, that of its symbol. ``table`` is in ln."""
    mask = (1 << BITS) - 1
    # A run that repeats is looked up once, and the symbols' normaliser is made once for each context.
    keys, back = np.unique(keys, return_inverse=True)
    contexts, of = np.unique(keys >> BITS, return_inverse=True)
    two, one = contexts >> BITS, contexts & mask
    context, cell = p["one"].take(one, axis=0), symbol[two] * SYMBOLS + symbol[one]
    context += p["two"].take(two, axis=0)
    longest = [float(np.einsum("ij,ij->i", x, x).max(initial=0)) ** 0.5 for x in (context, p["symbol"], p["group"], p["word"])]
    apart = longest[0] * max(longest[1:])
    last = keys & mask
    own, by_symbol = symbol[last], np.empty(len(keys))
    for i in range(0, len(contexts), IN_CACHE):
        scores = table.take(cell[i : i + IN_CACHE], axis=0)
        scores += context[i : i + IN_CACHE] @ p["symbol"].T
        low, high = np.searchsorted(of, [i, i + IN_CACHE])
        here = of[low:high] - i
        by_symbol[low:high] = scores[here, own[low:high]] - _log_sums(scores, apart)[here]

    order = np.argsort(own * len(groups.place) + groups.place[last])
    last, own, found = last[order], own[order], by_symbol[order]
    a, b = np.searchsorted(own, [SINGLE, RARE])
    place = groups.place[last[a:b]]
    group, rows = groups.group[place], context.take(of[order[a:b]], axis=0)
    for child, parent, starts, kind, share in (
        (group, own[a:b], groups.group_starts, "group", groups.group_share), (place, group, groups.starts, "word", groups.word_share),
    ):
        begins = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]]) if len(parent) else []
        for i, j in zip(begins, [*begins[1:], len(parent)]):
            low, high = starts[parent[i]], starts[parent[i] + 1]
            if high - low > 1:
                x = rows[i:j] @ p[kind][low:high].T
                x += share[low:high]
                found[a + i : a + j] += x[np.arange(j - i), child[i:j] - low] - _log_sums(x, apart)
    out = np.empty(len(keys))
    out[order] = found
    return out[back]


class Model:
    """A fitted model: the words' counts as a table, the known words, the symbols' table, and the
    groups and vectors."""

    def __init__(self, counts: DataFrame, lexicon: Lexicon, table: np.ndarray, groups: Groups, vectors: dict[str, np.ndarray]):
        self.counts, self.lexicon, self.table, self.groups, self.vectors = counts, lexicon, table, groups, vectors


def learn(docs: DataFrame) -> Model:
    """A model of the documents whose crc32 of the id modulo 7 is not 2; all of them are counted."""
    train = docs.filter(crc_mod("doc_id", HELD_OUT_MOD) != HELD_OUT)
    counts = _word_counts(train)
    tokens, kinds = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    least = least_count(counts, "n", KNOWN_WORDS)
    frequent = counts.filter(F.col("n") >= max(2, least)).toPandas()
    lexicon = Lexicon([bytes(w) for w in frequent["word"]], frequent["n"].to_numpy(), tokens or 0, kinds)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    runs = run_counts(train, shared)
    cells = _cell_counts(runs, shared)
    table = fit(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(float))
    groups = bands(lexicon)
    vectors = started(lexicon, groups)
    for turn in range(ROUNDS):
        vectors = trained(runs, lexicon, groups, vectors, table, lexicon.tokens, turn)
        if turn == 0:
            groups, vectors = regrouped(lexicon, groups, vectors)
    return Model(counts, lexicon, table, groups, vectors)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    ``base_score`` is of the unigram model with one added to each count, ``score`` of this one;
    both are log10 of the probability of the whole text and its end. A null or empty text is the
    end alone. A word that training never saw has the share of one more rare word. Rows that
    repeat are scored alike; other columns aren't looked at; an empty table gives no rows.
    """
    table = (model.table * np.log(10)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.groups, model.vectors, table))
    lexicon = model.lexicon

    def scorer():
        known, groups, vectors, table = shared.value
        index, size, symbol = known.index(), len(known.words), known.run_symbol()

        def scored(batch: dict) -> dict:
            out: dict = {"row": batch["row"], "doc_id": batch["doc_id"], "held_out": batch["held_out"], "n_tokens": [], "n_rare": [], "base": [], "model": []}
            rare: list[pa.ListArray] = []
            for words, ids, lengths in tokens_of([x and x.encode("utf-8", "surrogatepass") for x in batch["text"]]):
                at, starts = _known(words, index)[ids], np.cumsum(lengths) - lengths
                keys = runs_of(at, lengths, size)
                chances = np.concatenate([log_chances(keys[i : i + SCORED], symbol, groups, vectors, table) for i in range(0, len(keys), SCORED)])
                out["n_tokens"] += lengths.tolist()
                out["base"] += np.add.reduceat(known.log_count[at], starts).tolist()
                out["model"] += (np.add.reduceat(chances, starts) / np.log(10)).tolist()
                # Rare words of each document, by its place and the word's number.
                unknown = np.flatnonzero(at < 0)
                place = np.repeat(np.arange(len(lengths)), lengths)[unknown]
                out["n_rare"] += np.bincount(place, minlength=len(lengths)).tolist()
                found, n = np.unique(place * len(words) + ids[unknown], return_counts=True)
                place, number = np.divmod(found, len(words))
                each = pa.StructArray.from_arrays([pa.array([words[w] for w in number.tolist()], pa.binary()), pa.array(n, pa.int64())], ["word", "tf"])
                rare.append(pa.ListArray.from_arrays(np.r_[0, np.cumsum(np.bincount(place, minlength=len(lengths)))].astype(np.int32), each))
            return out | {"rare": pa.concat_arrays(rare)}

        return scored

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (crc_mod("doc_id", HELD_OUT_MOD) == HELD_OUT).alias("held_out"), "text")
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_rare long, base double, model double, rare array<struct<word: binary, tf: long>>"
    rows = written(mapped(rows, scorer, schema), "scored")

    # Words that are not known to every task: a row for each in each document, joined by the word.
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf")
    known = F.coalesce("n", F.lit(0))
    found = rare.join(model.counts.hint("shuffle_hash"), "word", "left").groupBy("row").agg(
        F.sum(F.col("tf") * F.log10(known + 1)).alias("logs"), F.sum(F.when(known > 0, F.col("tf")).otherwise(0)).alias("seen")
    )
    logs, seen = F.coalesce("logs", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    rare_norm = float(np.log10(lexicon.rare_tokens + lexicon.rare_kinds + 1))
    base_norm = float(np.log10(lexicon.tokens + lexicon.kinds + 1))
    return rows.drop("rare").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_tokens") - F.col("n_rare") + seen).alias("n_known"), F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * base_norm).alias("base_score"), (F.col("model") + logs - F.col("n_rare") * rare_norm).alias("score"),
    )
