"""Best-fit packing of documents into sequences, with bin counts certified by lower bounds.

Pieces are dealt over parts of like lengths and packed best-fit decreasing. Dual-feasible functions bound from
below how many bins a part needs, which certifies its packing or not. The loosest bins of a part,
more of them the further it is above its bound, are its gaps: their pieces meet in a pool with
those of sixteen parts and are packed again, round after round, until one pool is left.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, mapped, written

CAPACITY = 2048
#: Pieces that a part holds on average; parts are packed in one task each.
PART_PIECES = 50_000
#: Parts whose open bins meet in one pool.
FAN = 16
#: Loose bins that a part gives up, and as many more for each bin above its bound.
RELEASED = 8

_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_ODD_SPACE = re.compile(r"[^\S \n]")


#: The public pattern that splits a text before the merges of a byte-level vocabulary.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a byte-level tokenizer as bytes, without its special tokens. Bytes that
    print stand for themselves in the file, the others for the code points from 256 on."""
    with open(path, encoding="utf-8") as file:
        saved = json.load(file)
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (b for b in range(256) if b not in prints)
    byte = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t["content"] for t in saved["added_tokens"]}
    return {bytes(byte[c] for c in token): i for token, i in saved["model"]["vocab"].items() if token not in special}


@lru_cache(maxsize=2)
def _ids_of(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    # The same vocabulary; for short strings it takes a fraction of the time.
    short = tiktoken.Encoding("short", pat_str=_SPLIT, mergeable_ranks=_ranks(path), special_tokens={})
    chunks = Memo(lambda chunk: array("I", short.encode_ordinary(chunk)).tobytes(), 250_000)

    def ids(text: str) -> bytes:
        """Ids as little-endian 32-bit numbers.

        No token of this byte-level pattern crosses from a character that is no white space to
        white space, so chunks of blanks and the word after them are encoded on their own and
        remembered. Texts with other white space than blanks and line ends are encoded whole.
        """
        if _ODD_SPACE.search(text):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(chunks.__getitem__, _CHUNK.findall(text)))

    return ids


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first piece of several is shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of each document and a closing 0, cut to
    ``capacity``. A null or empty text is the closing 0 alone; rows that repeat are pieces of
    their own; a null id stays null."""

    def encoder():
        ids_of = _ids_of(tokenizer)

        def encoded(batch: dict) -> dict:
            out = []
            for key, body in zip(batch["doc_id"], batch["text"]):
                ids = ids_of(body or "") + b"\0\0\0\0"
                out += [(key, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*out) if out else [()] * 5))

        return encoded

    kind = dict(docs.dtypes)[doc_id]
    return mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), encoder, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each length, which come in decreasing order: the fullest bin that still has room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins, out = 0, 0, np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen, bins = capacity, bins, bins + 1
        out[i] = chosen
        left = room - n
        by_room[left].append(chosen)
        rooms |= 1 << left
    return out


def bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions."""
    if not len(lengths):
        return 0
    size, n = np.unique(lengths, return_counts=True)
    best = -(-int((size * n).sum()) // capacity)
    for small in size[size <= capacity // 2].tolist():
        value = np.where(size > capacity - small, capacity, np.where(size >= small, size, 0))
        best = max(best, -(-int((value * n).sum()) // capacity))
    for k in range(1, 9):
        scaled = size * (k + 1)
        # In units of 1 / (k * capacity): exact multiples keep their size, others round down.
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    return best


_PLACED = "piece int, start long, length long, ids_crc32 long, part long, sequence_id long, offset long, open boolean"


def _pack(rows: pd.DataFrame, level: int, capacity: int) -> pd.DataFrame:
    """One part or pool. Keeps the bins it came with unless fewer do; marks the bins to give up."""
    rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    lengths = rows["length"].to_numpy()
    chosen = best_fit(lengths, capacity)
    if level == 0 or chosen.max() + 1 < rows["sequence_id"].nunique():
        rows["sequence_id"] = (np.int64(level) << 58) | (rows["part"].to_numpy() << 26) | chosen
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
    held = rows.groupby("sequence_id")["length"].sum()
    above = len(held) - bound(lengths, capacity)
    loosest = held[held < capacity].nsmallest(RELEASED * (1 + max(0, above))).index
    rows["open"] = rows["sequence_id"].isin(loosest)
    return rows


def _packer(level: int, capacity: int):
    return lambda rows: _pack(rows, level, capacity)


def pack(cuts: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    No sequence is longer than ``capacity`` and offsets have no gaps. An empty table gives no
    rows; pieces of equal length and id may trade places.
    """
    kind = dict(cuts.dtypes)["doc_id"]
    schema = f"doc_id {kind}, {_PLACED}"
    cuts = written(cuts, "pieces")
    parts = max(1, -(-cuts.count() // part_pieces))
    # Every part gets an even choice of all lengths: buckets by hash, of which each is dealt in order
    # of length. Rows that repeat an id go to different buckets.
    bucket = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(parts))
    order = Window.partitionBy("bucket").orderBy("length", "doc_id", "piece")
    turn = cuts.withColumn("bucket", bucket).withColumn("part", F.pmod(F.row_number().over(order) + F.col("bucket"), F.lit(parts)).cast("long")).drop("bucket")
    dealt = turn.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "open": F.lit(True)})
    settled, level = [], 0
    while True:
        packed = written(dealt.groupBy("part").applyInPandas(_packer(level, capacity), schema), "packed")
        if parts == 1:
            settled.append(packed)
            break
        settled.append(packed.filter(~F.col("open")))
        parts, level = -(-parts // FAN), level + 1
        dealt = packed.filter("open").withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
    placed = settled[0]
    for more in settled[1:]:
        placed = placed.unionByName(more)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
