"""Document fingerprints from improbable features.

Every window of 32 bytes has an entropy; windows whose entropy class is rare in the corpus come
first. A window that is the rarest of its neighbourhood again and again is a feature. Features go
into chained Bloom filters, and two fingerprints are compared by the bits that their filters
share, against what chance and a perfect match would give.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, partitions

WINDOW = 32
CLASSES = 64
#: Windows of fewer classes than this are runs of few bytes; they identify nothing.
LEAST_CLASS = 6
#: Neighbouring windows that compete, and how often one must win to be a feature.
NEIGHBOURS, WINS = 32, 8
#: Texts of fewer bytes have too few windows to choose from.
SHORT = 128
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
_GAP = bytes(WINDOW + NEIGHBOURS)
_CHUNK = 1 << 19
_POINT = 1 << 16

_SUM = np.round(_POINT * np.arange(WINDOW + 1) * np.log2(np.maximum(1, np.arange(WINDOW + 1)))).astype(np.int64)
_STEP = np.diff(_SUM)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with gaps between them, where each starts, and how many windows it has."""
    data = np.frombuffer(_GAP.join(texts) + _GAP, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + len(_GAP)) - sizes - len(_GAP)
    return data, starts, np.maximum(0, sizes - WINDOW + 1)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """Class, 0 to 63, of the entropy of the window at each position.

    Sliding by one byte changes the sum of count * log(count) by what the byte that leaves and the
    byte that enters contribute; how often they are among the 31 bytes between is counted by
    comparing the data with itself at 31 distances. Sums are whole numbers, so equal windows have
    equal classes wherever they stand.
    """
    ahead, behind = np.zeros((2, len(data)), np.uint8)
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        ahead[:-k] += same
        behind[k:] += same
    change = _STEP[behind[WINDOW:]] - _STEP[ahead[: len(data) - WINDOW]]
    first = _SUM[np.bincount(data[:WINDOW], minlength=256)].sum()
    total = first + np.r_[0, np.cumsum(change)]
    return (CLASSES - 1 - total * (CLASSES - 1) // _SUM[WINDOW]).astype(np.int64)


def _inside(starts: np.ndarray, windows: np.ndarray, size: int) -> np.ndarray:
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + windows, -1)
    return edge[:size].cumsum() > 0


def class_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts are of each class."""
    counts = np.zeros(CLASSES, np.int64)
    for part in _chunks(texts):
        data, starts, windows = _joined(part)
        classes = entropy_classes(data)
        counts += np.bincount(classes[_inside(starts, windows, len(classes))], minlength=CLASSES)
    return counts


def _chunks(texts: list[bytes]):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) + len(_GAP)
        if size >= _CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _hashes(windows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes, whose length is a multiple of 8."""
    with np.errstate(over="ignore"):
        words = np.ascontiguousarray(windows).view(np.uint64)
        h = np.zeros(len(words), np.uint64)
        for i in range(words.shape[1]):
            h = (h ^ words[:, i]) * _ODD[i % 4]
            h ^= h >> np.uint64(31)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(27))


def features(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Hashes of the features of each text in order of place, each once.

    Every window of 8 bytes is a feature of a text of fewer than 128 bytes, and of one without
    any window that identifies something. A text of fewer than 8 bytes is one feature, an empty
    text has none.
    """
    out: list[np.ndarray] = []
    for part in _chunks(texts):
        data, starts, windows = _joined(part)
        classes = entropy_classes(data)
        valid = _inside(starts, windows, len(classes))
        order = np.where(valid & (classes >= LEAST_CLASS), rank[classes], CLASSES)
        key = (order << 40) | np.arange(len(order))
        for step in (1, 2, 4, 8, 16):
            key = np.minimum(key[:-step], key[step:])
        wins = np.bincount(key[valid[: len(key)]] & ((1 << 40) - 1), minlength=len(order))
        chosen = np.flatnonzero((wins >= WINS) & (order < CLASSES))
        found = _hashes(data[chosen[:, None] + np.arange(WINDOW)]) if len(chosen) else np.empty(0, np.uint64)
        bounds = np.searchsorted(chosen, np.r_[starts, len(data)])
        for i, text in enumerate(part):
            own = found[bounds[i] : bounds[i + 1]]
            if text and (len(text) < SHORT or not len(own)):
                raw = np.frombuffer(text + bytes(max(0, 8 - len(text))), np.uint8)
                own = _hashes(np.lib.stride_tricks.sliding_window_view(raw, 8))
            out.append(own[np.sort(np.unique(own, return_index=True)[1])])
    return out


class Fingerprint:
    """Chained filters: every one holds 160 features but the last, which holds the rest."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        filters = -(-self.n // FILTER_FEATURES)
        bits = np.zeros(filters * FILTER_BITS, bool)
        base = np.arange(self.n) // FILTER_FEATURES * FILTER_BITS
        for i in range(HASHES):
            bits[base + ((hashes >> np.uint64(11 * i)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        self.bits = bits.reshape(filters, FILTER_BITS)

    def text(self) -> str:
        return f"{self.n}:{base64.b64encode(np.packbits(self.bits)).decode()}"

    @classmethod
    def parsed(cls, text: str) -> Fingerprint:
        made = cls.__new__(cls)
        n, _, body = text.partition(":")
        made.n = int(n)
        made.bits = np.unpackbits(np.frombuffer(base64.b64decode(body), np.uint8)).astype(bool).reshape(-1, FILTER_BITS)
        return made

    def likeness(self, other: Fingerprint) -> float:
        """Normalised overlap: 0 for what chance gives, 1 for a filter that lies in the other.

        Each filter of the shorter chain takes its best partner; filters weigh by their features.
        Two empty fingerprints are alike, an empty one and another are not.
        """
        if not self.n or not other.n:
            return float(self.n == other.n)
        small, large = (self, other) if (self.n, self.text()) <= (other.n, other.text()) else (other, self)
        a, b = small.bits.astype(np.float32), large.bits.astype(np.float32)
        na, nb = a.sum(1)[:, None], b.sum(1)[None, :]
        chance, most = na * nb / FILTER_BITS, np.minimum(na, nb)
        best = np.clip((a @ b.T - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(1)
        weight = np.full(len(a), FILTER_FEATURES, float)
        weight[-1] = small.n - FILTER_FEATURES * (len(a) - 1)
        return float(min(1.0, (best * weight).sum() / weight.sum()))


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Place of each entropy class, the rarest in all texts first; a parameter of ``fingerprints``,
    so that fingerprints of different tables can be made alike."""

    def counter():
        def counted(batch: dict) -> dict:
            n = class_counts([(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]])
            return {"class": range(CLASSES), "n": n}

        return counted

    rows = mapped(docs.select(F.col(text).alias("text")), counter, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES, np.int64)
    for r in rows:
        counts[r["class"]] = r["n"]
    rank = np.empty(CLASSES, np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(CLASSES)
    return rank


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``key``, found in two steps of their square root."""
    width = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + width] for i in range(0, len(bounds), width)] or [[]]
    values = lambda x: F.array(*map(F.lit, x)) if x else F.array().cast("array<bigint>")
    below = lambda a: F.size(F.filter(a, lambda b: b <= key))
    coarse = F.greatest(F.lit(1), below(values([r[0] for r in rows if r])))
    return ((coarse - 1) * width + below(F.element_at(F.array(*map(values, rows)), coarse))).cast("int")


def in_order(docs: DataFrame) -> DataFrame:
    """bucket, guest, key, doc_id, text: ranges of ids, each sorted and closed by a guest row, the
    first row of the next range (of the first one for the last). No task sees more than its ranges.

    Null ids come last; rows that repeat an id are in order of their text.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(key.alias("key"), "doc_id", "text")
    buckets = 4 * partitions(docs.sparkSession)
    ranks = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    bounds = rows.select("key").agg(F.percentile_approx("key", ranks, F.lit(20 * buckets)).alias("q")).first()["q"]
    rows = rows.withColumn("bucket", _bucket(F.col("key"), sorted(set(bounds or []))))
    least = {r["bucket"]: r["key"] for r in rows.select("bucket", "key").groupBy("bucket").agg(F.min("key").alias("key")).collect()}
    order = sorted(least)
    before = dict(zip((least[b] for b in order), [order[-1], *order[:-1]])) if order else {}
    own = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    both = own
    if before:
        places = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        guest = F.struct(F.element_at(places, F.col("key")).alias("bucket"), F.lit(True).alias("guest"))
        both = F.when(F.col("key").isin(list(before)), F.array(own, guest)).otherwise(F.array(own))
    else:
        both = F.array(own)
    dealt = rows.select("key", "doc_id", "text", F.explode(both).alias("at")).select("at.bucket", "at.guest", "key", "doc_id", "text")
    return dealt.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "guest", "key", "text")


def fingerprints(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of
    the next document, in order of id. A null text counts as the empty one. A table of one document
    is its own next. Other columns are not looked at; an empty table gives no rows.
    """
    rank = rarity(docs) if rank is None else rank

    def maker():
        import hashlib

        last: list = []  # bucket, id, text and fingerprint of the row that still waits for its next

        def made(batch: dict) -> dict:
            rows = list(zip(batch["bucket"], batch["guest"], batch["doc_id"], [t or "" for t in batch["text"]]))
            prints = [Fingerprint(h) for h in features([r[3].encode("utf-8", "surrogatepass") for r in rows], rank)]
            pairs, edits = [], []
            for row, own in zip(rows, prints):
                if last and last[0][0] == row[0] and not last[0][1]:
                    _, _, doc, text = last[0]
                    half = len(text) // 2
                    pairs.append((doc, len(text), last[1], own))
                    edits.append((text[: len(text) - half] + row[3][:half]).encode("utf-8", "surrogatepass"))
                last[:] = [row, own]
            out: dict = {k: [] for k in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
            for (doc, n, own, following), edited, found in zip(pairs, edits, features(edits, rank)):
                other = Fingerprint(found)
                for k, v in zip(out, (doc, n, hashlib.sha256(edited).hexdigest(), own.text(), other.text(), own.likeness(other), own.likeness(following))):
                    out[k].append(v)
            return out

        return made

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return mapped(in_order(docs), maker, schema)
