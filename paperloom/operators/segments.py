"""Segments of long documents: whole paragraphs, packed in order up to a number of characters.

A segment's end depends on where it began, so the plain way is a fold over a document. Here every
paragraph first gets the paragraph at which a segment would end that begins with it, by a scan over
running lengths; the segments that are real are then found from the first paragraph on by jumps of
doubling length. A document of any length is so spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..functions.scans import Running, running
from ..functions.staging import staged

#: Characters of a segment (fixed value), and segments' worth of characters in a block of a scan.
LIMIT, BLOCK_SEGMENTS = 6_000, 64


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, i, block``: paragraphs stand between blank lines. Blank and null texts have none."""
    text = tx.strip(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", text.alias("t")).filter("t <> ''").select("doc_id", F.posexplode(F.split("t", r"(?U)\n\s*\n")).alias("i", "block"))


def segment_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id, page, text``: a segment ends before the paragraph that would take it over ``limit``
    characters, separators not counted; a longer paragraph is a segment of its own. Pages count from 1.
    Ids are taken as unique."""
    blocks = staged(paragraphs(docs).withColumn("n", F.length("block").cast("bigint")), "paragraphs")
    part = F.floor(F.col("i") / 1_000)
    lengths = staged(running(blocks.select("doc_id", "i", "n"), ["doc_id"], ["i"], part, {"upto": Running("sum", F.col("n"))}), "lengths")
    # Ends: the first paragraph whose running length passes that before the start by more than the limit.
    asked = lengths.select("doc_id", (F.col("upto") - F.col("n") + limit).alias("value"), F.lit(1).alias("kind"), "i")
    there = lengths.select("doc_id", F.col("upto").alias("value"), F.lit(0).alias("kind"), "i")
    nearest = Running("last", F.when(F.col("kind") == 0, F.col("i")), inclusive=False)
    found = running(asked.unionByName(there), ["doc_id"], ["value", "kind", "i"], F.floor(F.col("value") / (limit * BLOCK_SEGMENTS)), {"end": nearest}, reverse=True)
    jumps = staged(found.filter("kind = 1 AND end IS NOT NULL").select("doc_id", "i", F.greatest(F.col("end"), F.col("i") + 1).alias("end")), "jumps")
    last = lengths.groupBy("doc_id").agg(F.max("i").alias("last"))
    jumps = staged(jumps.join(last, "doc_id").filter("end <= last").drop("last"), "jumps")
    # Two neighbours among the segments hold more than the limit, which bounds their number.
    longest = lengths.agg(F.max("upto")).first()[0] or 0
    starts = lengths.filter("i = 0").select("doc_id", "i")
    for _ in range(math.ceil(math.log2(2 * longest / limit + 2))):
        reached = starts.join(jumps, ["doc_id", "i"]).select("doc_id", F.col("end").alias("i"))
        starts = staged(starts.unionByName(reached), "starts")
        onward = jumps.select("doc_id", F.col("i").alias("end"), F.col("end").alias("further"))
        jumps = staged(jumps.join(onward, ["doc_id", "end"]).select("doc_id", "i", F.col("further").alias("end")), "jumps")
    marked = blocks.join(starts.withColumn("begins", F.lit(1).cast("bigint")), ["doc_id", "i"], "left").withColumn("begins", F.coalesce("begins", F.lit(0)))
    paged = running(marked.select("doc_id", "i", "block", "begins"), ["doc_id"], ["i"], part, {"page": Running("sum", F.col("begins"))})
    # A segment's text is bounded by the limit, or is one paragraph.
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "block"))), lambda x: x["block"]), "\n\n")
    return paged.groupBy("doc_id", "page").agg(joined.alias("text"))
