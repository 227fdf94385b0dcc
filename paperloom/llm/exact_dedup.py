"""Exact de-duplication by a 128-bit content hash, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, written

BUCKETS = 1 << 16
SALTS = 64
#: A group is hot when it has more rows than both of these: so many, and this share of all rows.
HOT_ROWS = 1_000
HOT_SHARE = 1 / 2_000


def _hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(body)).alias("hash"), F.sha2(body, 256).alias("sha"), body.alias("body"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("hash"), F.lit(BUCKETS)).cast("int")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Documents are grouped by the 128-bit hash of their text and, inside a group, by the bytes of
    the text itself, so that a collision of the hash joins nothing. Of equal texts the row with
    the largest id stays. A null text counts as the empty one. Rows that repeat an id and a text
    count as members; one of them stays. A null id is never kept beside an id; of texts with null
    ids only, one row stays. An empty table gives no rows. Other columns are not looked at.

    The texts are aggregated before the shuffle, so a group of copies sends one row per task. The
    way back to the documents joins hashes only; hot groups are dealt over ``SALTS`` parts.
    """
    hashed = _hashed(docs, doc_id, text)
    by_bytes = hashed.groupBy("hash", "sha", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    classes = by_bytes.groupBy("hash", "sha").agg(
        F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")
    )
    # Texts that differ and share both digests could not be told apart on the way back.
    clash = F.raise_error(F.lit("two texts share their 128-bit and 256-bit digests"))
    classes = written(classes.select("hash", "sha", "keep_id", F.when(F.col("texts") > 1, clash.cast("long")).otherwise(F.col("n")).alias("n")), "exact-groups")

    total = classes.agg(F.sum("n")).first()[0] or 0
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    # At most 1 / HOT_SHARE groups can be hot, so this list is bounded.
    hot = [r[0] for r in classes.filter(F.col("n") > least).select(_bucket()).distinct().collect()]
    is_hot = _bucket().isin(hot) if hot else F.lit(False)
    salted = classes.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    rows = hashed.drop("body").withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))

    joined = rows.join(salted, ["hash", "sha", "salt"])
    # Uses the partitioning of the join; tells rows that repeat the same id and text apart.
    turn = F.row_number().over(Window.partitionBy("hash", "sha", "salt", "doc_id").orderBy("doc_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (turn == 1)
    return joined.select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; of rows with equal id and text one stays.

    Nulls and empty tables as in ``exact_groups``.
    """
    names = docs.columns
    of, sha, stays, place = free_names(docs, "of", "sha", "stays", "place")
    body = F.coalesce(F.col(text), F.lit(""))
    gone = exact_groups(docs, doc_id, text).groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("rows"), F.max("kept").alias("stays"))
    # Only ids with something to drop take part: a document without a copy isn't looked up.
    gone = gone.filter(~F.col("stays") | (F.col("rows") > 1)).select(F.col("doc_id").alias(of), F.col("text_sha256").alias(sha), F.col("stays").alias(stays))
    marked = docs.join(gone, F.col(doc_id).eqNullSafe(F.col(of)) & (F.sha2(body, 256) == F.col(sha)), "left")
    single = marked.filter(F.col(stays).isNull()).select(*names)
    again = marked.filter(F.col(stays))
    turn = F.row_number().over(Window.partitionBy(of, sha).orderBy(*[c for c, t in docs.dtypes if not t.startswith("map")]))
    return single.unionByName(again.withColumn(place, turn).filter(F.col(place) == 1).select(*names))
