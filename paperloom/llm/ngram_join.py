"""Size-aware Jaccard join of documents on word n-grams, and its connected components.

Equal sets are one node. Small sets are joined by enumerating their subsets of the size that two
similar sets must share: sharing one is a link, without another check. Large sets are joined by
scanning inverted lists over the part of each set that a similar set cannot avoid. A cost model
chooses the boundary between the two. In a list every set is first compared with one leader; only
sets that are still in different components are then compared with each other, so a group of near
copies costs as many comparisons as it has members and no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import Memo, free_names, mapped, written
from .components import components

#: Sets of at most so many shingles may be joined by subsets, if at most two elements are left out.
LEFT_OUT = 2
#: Cost of a row of an inverted list, with the comparisons that it causes, in rows of a subset.
SCAN_COST = 4.0
#: Buckets by which shingles are told common from rare; two bits for each, 8 MB, are broadcast.
LEVEL_BITS = 25
#: Documents more than chance puts into a bucket before its shingles are common.
COMMON_LEAST = 8
#: Buckets of document ids by which sets are fetched for comparison; a fixed 2^20 bits are sent.
ID_BUCKETS = 1 << 20
SALTS, HOT_ROWS, HOT_SHARE, SIG_BUCKETS = 64, 1_000, 1 / 2_000, 1 << 16

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread evenly, then cut to 63 bits so that they are positive numbers in Spark."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).view(np.int64)


class Shingler:
    """Sorted distinct 63-bit hashes of the word n-grams of a text."""

    def __init__(self, n: int):
        self.n, self.words = n, Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.int64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        with np.errstate(over="ignore"):
            total = np.full(len(h) - n + 1, np.uint64(n), np.uint64)
            for i in range(n):
                total = (total ^ h[i : len(h) - n + 1 + i]) * _ODD[i % len(_ODD)]
                total ^= total >> np.uint64(29)
        return np.unique(_mixed(total))


class Rule:
    """What a similarity of at least num / den asks of sizes and overlaps, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, a: int, b: int) -> int:
        """The least overlap of similar sets of sizes ``a`` and ``b``."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def smallest(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        """Elements, in any order common to all sets, of which a similar set shares one at least."""
        return n - self.smallest(n) + 1

    def shared(self, n: int) -> int:
        """Elements that a similar set of at least this size shares with the longer ``head``."""
        return max(1, self.prefix(n) // 2)

    def head(self, n: int) -> int:
        """With that many more elements than ``prefix`` but one, similar sets share ``shared`` of them
        at least, by the same argument; the smaller set of two says how many."""
        return min(n, n - self.smallest(n) + self.shared(n))

    def subset_sizes(self, n: int) -> list[int]:
        """Overlaps that a set of ``n`` can need with a similar set of any size."""
        largest = self.den * n // self.num
        return sorted({c for m in range(self.smallest(n), largest + 1) if (c := self.overlap(n, m)) <= min(n, m)})

    def largest_small(self) -> int:
        """The largest size of which no needed subset leaves out more than ``LEFT_OUT`` elements; 0 if
        only equal sets are similar, as these are one node already."""
        if self.num == self.den:
            return 0
        n = 1
        while all(n + 1 - c <= LEFT_OUT for c in self.subset_sizes(n + 1)):
            n += 1
        return n

    def subset_rows(self, n: int) -> int:
        return sum(1 if n == c else n if n == c + 1 else n * (n - 1) // 2 for c in self.subset_sizes(n))


def _subsets(values: np.ndarray, c: int) -> np.ndarray:
    """Keys of the subsets of size ``c``: sums of their hashed elements, modulo 2^64."""
    left = len(values) - c
    with np.errstate(over="ignore"):
        total = values.sum(dtype=np.int64)
        if left == 0:
            return np.array([total])
        if left == 1:
            return total - values
        i, j = np.triu_indices(len(values), 1)
        return total - values[i] - values[j]


def _levels(docs: DataFrame, n: int) -> np.ndarray:
    """How common the shingles of each bucket are, 0 to 3, two bits each.

    Documents are counted for every shingle, whatever task sees it, in a fixed number of buckets. A
    level is how far a bucket's count lies above what chance puts into one. The result only sets the
    order of elements, so shingles that share a bucket change the work and not the links.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, buckets = Shingler(n), np.zeros(1 << LEVEL_BITS, "u2")
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at = shingler(text) & ((1 << LEVEL_BITS) - 1)
                buckets[at] = np.minimum(buckets[at], 65_534) + 1
        task = TaskContext.get().partitionId()
        for chunk, at, held in sketch.chunks(buckets):
            columns = [pa.array([chunk], pa.int32()), pa.array([task], pa.int32()), pa.array([at]), pa.array([held]), pa.array([int(np.frombuffer(held, "i8").sum())])]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "task", "at", "held", "n"])

    counts = written(docs.select("text").mapInArrow(counted, "chunk int, task int, at binary, held binary, n long"), "counts")
    chance = (counts.agg(F.sum("n")).first()[0] or 0) / (1 << LEVEL_BITS)
    least = chance + 4 * chance**0.5 + COMMON_LEAST

    def pack(total: np.ndarray) -> np.ndarray:
        level = (total >= least).astype(np.uint8) + (total >= 4 * least) + (total >= 16 * least)
        return level.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)

    return sketch.collected(counts, 1 << LEVEL_BITS, pack)


def _hashed(docs: DataFrame, n: int, rule: Rule, levels: np.ndarray) -> DataFrame:
    """doc_id, n (size of the set), sig (128 bits of the set), head (its first elements in the
    common order, by level and then by hash), take (how many of them are its prefix), rare (elements
    of the lowest level), small (the set, if small)."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    largest = rule.largest_small()

    def hasher():
        shingler, packed = Shingler(n), shared.value

        def hashed(batch: dict) -> dict:
            out: dict = {"doc_id": batch["doc_id"], "n": [], "sig": [], "head": [], "take": [], "rare": [], "small": []}
            for text in batch["text"]:
                values = shingler(text)
                size = len(values)
                take = rule.head(size) if size else 0
                bucket = values & ((1 << LEVEL_BITS) - 1)
                level = (packed[bucket >> 2] >> (2 * (bucket & 3)).astype(np.uint8)) & 3
                head = values[np.argsort(level, kind="stable")[:take]]
                out["n"].append(size)
                out["sig"].append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                out["head"].append(head)
                out["take"].append(rule.prefix(size) if size else 0)
                out["rare"].append(int((level == 0).sum()))
                out["small"].append(values if size <= largest else values[:0])
            return out

        return hashed

    return mapped(docs, hasher, "doc_id long, n int, sig binary, head array<long>, take int, rare int, small array<long>")


def _starred(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(a, b, na, nb, pa, pb, *keys): each row's node b and its list's leader a, the least by ``order``."""
    leader = F.min(F.struct(*order, F.col("n").alias("na"), F.col("node").alias("a"), F.col("pos").alias("pa"))).alias("l")
    leaders = rows.groupBy(*keys).agg(leader, F.count(F.lit(1)).alias("held")).filter("held > 1").select(*keys, "l.na", "l.a", "l.pa")
    return rows.join(leaders, keys).filter("node <> a").select("a", F.col("node").alias("b"), "na", F.col("n").alias("nb"), "pa", F.col("pos").alias("pb"), *keys)


def _boundary(nodes: DataFrame, rule: Rule) -> int:
    """The size up to which sets are joined by subsets: the cheapest, given how many sets there are
    of each size. 0 if subsets never pay."""
    largest = rule.largest_small()
    sizes = {r["n"]: r["count"] for r in nodes.filter(F.col("n") <= largest).groupBy("n").count().collect()}

    def cost(x: int) -> float:
        subsets = sum(k * rule.subset_rows(n) for n, k in sizes.items() if n <= x)
        scans = sum(k * rule.prefix(n) for n, k in sizes.items() if n >= rule.smallest(x + 1))
        return subsets + SCAN_COST * scans

    return min(range(largest + 1), key=cost)


def _small_links(nodes: DataFrame, rule: Rule, most: int) -> DataFrame:
    """Links between sets of at most ``most`` elements. A subset's smallest holder is linked to all
    other holders that need no larger overlap with it; any two linked holders meet there."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for node, n, values in zip(batch["node"], batch["n"], batch["small"]):
                for c in rule.subset_sizes(n):
                    found = _subsets(np.asarray(values, np.int64), c)
                    out.append(pd.DataFrame({"c": c, "subset": found, "node": node, "n": n}))
            if out:
                yield pd.concat(out, ignore_index=True)

    rows = nodes.filter(F.col("n") <= most).select("node", "n", "small").mapInPandas(listed, "c int, subset long, node long, n int")
    stars = _starred(rows.withColumn("pos", F.lit(0)), ["c", "subset"], ["n", "node"])
    return stars.filter(_need(rule) <= F.col("c")).select("a", "b").distinct()


def _bits(ids: DataFrame, column: str) -> np.ndarray:
    """Buckets of ids as bits; never more than ``ID_BUCKETS`` of them, whatever the number of ids."""
    buckets = ids.select(F.pmod(F.xxhash64(column), F.lit(ID_BUCKETS)).cast("int").alias("k")).distinct().toPandas()["k"]
    bits = np.zeros(ID_BUCKETS, bool)
    bits[buckets.to_numpy(int)] = True
    return np.packbits(bits)


def _likely(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that share enough of their heads to be similar; no similar pair is lost."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("head").alias("ha"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("head").alias("hb"))
    n = F.least("na", "nb")
    # Rule.prefix and Rule.shared of the smaller set.
    prefix = n - F.ceil(F.lit(rule.num) * n / F.lit(rule.den)) + 1
    need = F.greatest(F.lit(1), F.floor(prefix / 2))
    both = pairs.join(right, "b").join(left, "a")
    return both.filter(F.size(F.array_intersect("ha", "hb")) >= need).select("a", "b")


def _similar(pairs: DataFrame, docs: DataFrame, n: int, rule: Rule) -> DataFrame:
    """The pairs (a, b) of documents whose sets are similar, by exact intersection.

    Texts travel, as they are smaller than their sets. A bit map of fixed size sorts out most that
    no pair needs before anything is shuffled; the joins sort out the rest.
    """
    shared = docs.sparkSession.sparkContext.broadcast((_bits(pairs, "a"), _bits(pairs, "b")))

    def chooser():
        first, second = (np.unpackbits(x).view(bool) for x in shared.value)

        def chosen(batch: dict) -> dict:
            rows = [(d, t, first[k], second[k]) for d, t, k in zip(batch["doc_id"], batch["text"], batch["k"]) if first[k] or second[k]]
            return dict(zip(("node", "text", "first", "second"), zip(*rows) if rows else [()] * 4))

        return chosen

    def comparer():
        shingler, known = Shingler(n), {}

        def compared(batch: dict) -> dict:
            a, b = [], []
            for one, two, text_a, text_b in zip(batch["a"], batch["b"], batch["ta"], batch["tb"]):
                if known.get("text") != text_a:  # pairs of one leader come one after another
                    known.update(text=text_a, values=shingler(text_a))
                left, right = known["values"], shingler(text_b)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if rule.den * both >= rule.num * (len(left) + len(right) - both):
                    a.append(one)
                    b.append(two)
            return {"a": a, "b": b}

        return compared

    keyed = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(ID_BUCKETS)).cast("int").alias("k"))
    texts = written(mapped(keyed, chooser, "node long, text string, first boolean, second boolean"), "texts")
    left = texts.filter("first").select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.filter("second").select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return mapped(both, comparer, "a long, b long").distinct()


def _need(rule: Rule) -> Column:
    """Rule.overlap of the sizes na and nb."""
    return F.ceil(F.lit(rule.num) * (F.col("na") + F.col("nb")) / F.lit(rule.num + rule.den))


def _can_be(rule: Rule) -> Column:
    """Whether sets whose first common element stands at pa and pb can be similar. A later common
    element may fail where the first one passes, so no similar pair is lost."""
    return F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= _need(rule)


def linked(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document; similar means Jaccard >= num / den.

    Words are runs of characters other than ASCII white space, with A-Z in lower case. A text with
    fewer than ``n`` words is one shingle; one without words is empty and linked with nothing, as
    is a null text. A null id is in no link, and its component is null unless its set equals
    another document's. Rows that repeat an id count as one document. An empty table gives no
    rows. Hashes of 63 bits stand for shingles.
    """
    rule = Rule(num, den)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hashed = written(_hashed(docs, n, rule, _levels(docs, n)), "hashed")
    first = F.min_by(F.struct("n", "head", "take", "rare", "small"), "doc_id").alias("own")
    classes = hashed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("held"), first)
    nodes = written(classes.select("sig", "node", "held", "own.*"), "nodes")

    most = _boundary(nodes, rule)
    large = nodes.filter(F.col("n") >= rule.smallest(most + 1))
    lists = large.select("node", "n", "rare", F.posexplode(F.slice("head", F.lit(1), F.col("take"))).alias("pos", "shingle"))
    often = lists.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("shingle")
    lists = written(lists.join(often, "shingle"), "lists")
    # Leaders of lists by size class, as sets of other sizes can't be similar to them. The set with
    # the fewest elements of its own is the likeliest to be what near copies were made from.
    width = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num))) if num < den else F.col("n")
    stars = _starred(lists.withColumn("width", width), ["shingle", "width"], ["rare", "n", "node"])
    tested = written(stars.filter(_can_be(rule)).select("a", "b").distinct(), "stars")
    edges = written(_similar(written(_likely(tested, nodes, rule), "likely"), docs, n, rule).unionByName(_small_links(nodes, rule, most)), "links")
    found = components(edges)

    # What is left: sets that share a list and are not yet in one component.
    placed = lists.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # A list's main component is only met by the sets outside it, so its members don't meet each other.
    held = placed.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("held"))
    mixed = held.groupBy("shingle").agg(F.max_by("component", F.struct("held", "component")).alias("main"), F.count(F.lit(1)).alias("parts"))
    rest = written(placed.join(mixed.filter("parts > 1").select("shingle", "main"), "shingle"), "mixed")
    outside = rest.filter("component <> main").select("shingle", "main", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("component").alias("ca"))
    every = rest.select("shingle", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("component").alias("cb"))
    once = (F.col("ca") < F.col("cb")) | (F.col("cb") == F.col("main"))
    pairs = outside.join(every, "shingle").filter((F.col("ca") != F.col("cb")) & once & _can_be(rule)).select("a", "b").distinct()
    known = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = written(_likely(pairs.join(known, ["a", "b"], "left_anti"), nodes, rule), "rest")
    if not pairs.isEmpty():
        more = written(_similar(pairs, docs, n, rule), "links")
        if not more.isEmpty():
            found = components(edges.unionByName(more))

    named = nodes.select("sig", "node", "held").join(found, "node", "left").select("sig", "held", F.coalesce("component", "node").alias("component_id"))
    named = written(named, "named")
    return _with_component(hashed, named)


def _with_component(hashed: DataFrame, named: DataFrame) -> DataFrame:
    """Component of every document by the hash of its set; hot sets are dealt over ``SALTS`` parts."""
    bucket = F.pmod(F.xxhash64("sig"), F.lit(SIG_BUCKETS)).cast("int")
    total = named.agg(F.sum("held")).first()[0] or 0
    hot = [r[0] for r in named.filter(F.col("held") > max(HOT_ROWS, int(total * HOT_SHARE))).select(bucket).distinct().collect()]
    is_hot = bucket.isin(hot) if hot else F.lit(False)
    salted = named.select("sig", "component_id", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    rows = hashed.select("doc_id", "n", "sig", F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)).alias("salt"))
    joined = rows.join(salted, ["sig", "salt"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id"))
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce(own, "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that have the smallest id of their component, with all their columns.

    Documents without words and with null ids stay, as they are linked with nothing.
    """
    found = linked(docs, n, num, den, doc_id, text)
    (other,) = free_names(docs, "other")
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(other)).distinct()
    return docs.join(gone, F.col(doc_id) == F.col(other), "left_anti")
