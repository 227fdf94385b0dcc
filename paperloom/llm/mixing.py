"""Mixing sources by temperature, in DataFrame operations.

The token share of each source is raised to an exponent that a bracketing search finds, so that
the mixture reaches a target entropy without repeating any source more often than allowed. Each
source's documents lie in blocks; every epoch takes its blocks in a permutation of its own, until
the source's part of the budget is used up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, written

#: Blocks that a source's documents are dealt into; a budget is met to within one block.
BLOCKS = 256
#: Entropy to reach, as a share of that of equal weights, and how often a source may be repeated.
ENTROPY_SHARE = 0.9
MOST_REPEATS = 4.0
#: Points at which one job tries the exponent, and rounds of narrowing: 16^-6 in the end.
POINTS, ROUNDS = 17, 6
_WORD = r"[^\x20\x09-\x0D]+"


def _tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def _block(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id), F.lit(6)), F.lit(BLOCKS)).cast("int")


def exponent(sources: DataFrame, repeats_at_par: float, entropy_share: float, most_repeats: float) -> float:
    """The exponent, 0 to 1, for shares p: the largest that reaches the entropy, or the smallest
    that keeps to the repetition limit if that is larger.

    ``repeats_at_par`` is the budget as a multiple of all tokens: how often every source is seen
    at exponent 1. Entropy falls and repetition falls as the exponent grows, so each bound lies
    between two neighbouring points of a grid, and the next round takes a grid between these.
    """
    def measured(points: list[float]) -> list[tuple[float, float]]:
        """Entropy and most repeats at each point, by one aggregation over (source, point)."""
        at = F.posexplode(F.array(*map(F.lit, points))).alias("i", "a")
        logs = sources.select(F.log("p").alias("l"), at).withColumn("w", F.exp(F.col("a") * F.col("l")))
        sums = logs.groupBy("i").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("l")).alias("zl"), F.max((F.col("a") - 1) * F.col("l")).alias("top"))
        found = {r["i"]: r for r in sums.collect()}
        return [(math.log(r["z"]) - a * r["zl"] / r["z"], repeats_at_par * math.exp(r["top"]) / r["z"]) for a, r in ((a, found[i]) for i, a in enumerate(points))]

    kinds = sources.count()
    if kinds < 2:
        return 1.0
    target = entropy_share * math.log(kinds)
    low = {"entropy": 0.0, "repeats": 0.0}
    high = {"entropy": 1.0, "repeats": 1.0}
    for _ in range(ROUNDS):
        grids = {k: [low[k] + (high[k] - low[k]) * i / (POINTS - 1) for i in range(POINTS)] for k in low}
        seen = measured(grids["entropy"] + grids["repeats"])
        # The largest point that still reaches the entropy; its bracket goes up from there.
        fits = [i for i in range(POINTS) if seen[i][0] >= target]
        i = max(fits, default=0)
        low["entropy"], high["entropy"] = grids["entropy"][i], grids["entropy"][min(i + 1, POINTS - 1)]
        # The smallest point that keeps the limit; its bracket goes down from there.
        fits = [i for i in range(POINTS) if seen[POINTS + i][1] <= most_repeats]
        i = min(fits, default=POINTS - 1)
        low["repeats"], high["repeats"] = grids["repeats"][max(i - 1, 0)], grids["repeats"][i]
    return round(max(low["entropy"], high["repeats"] if high["repeats"] > 16.0**-ROUNDS else 0.0), 6)


def draws(
    docs: DataFrame, budget: int | None = None, entropy_share: float = ENTROPY_SHARE, most_repeats: float = MOST_REPEATS,
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """source, weight, epochs, block, epoch, place of every block that is drawn, once for each epoch.

    ``budget`` is in tokens, all tokens of the table if not given. Every epoch takes a source's blocks
    in an order of its own. In the last epoch, which the source's part of the budget doesn't fill, a
    block is taken if that brings the tokens nearer to the part; one that doesn't is passed over, and
    later ones may still be taken. A null source is a source of its own. Sources without a token have
    weight 0 and one epoch, as their documents cost nothing. Of equal hashes the lower block comes first.
    """
    blocks = docs.groupBy(F.col(source).alias("source"), _block(doc_id).alias("block")).agg(F.sum(_tokens(text)).alias("tokens"))
    blocks = written(blocks, "blocks")
    sizes = blocks.groupBy("source").agg(F.sum("tokens").alias("total"))
    all_tokens = sizes.agg(F.sum("total")).first()[0] or 0
    budget = all_tokens if budget is None else budget
    sources = written(sizes.withColumn("p", F.col("total") / F.lit(float(max(1, all_tokens)))), "sources")
    filled = sources.filter("total > 0")
    a = exponent(filled, budget / max(1, all_tokens), entropy_share, most_repeats)
    z = filled.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    weight = F.when(F.col("total") > 0, F.pow("p", F.lit(a)) / F.lit(z)).otherwise(F.lit(0.0))
    weighted = sources.select(F.col("source").alias("same"), "total", F.round(weight, 9).alias("weight"))
    epochs = F.when(F.col("total") > 0, F.col("weight") * F.lit(float(budget)) / F.col("total")).otherwise(F.lit(1.0))
    weighted = weighted.withColumn("epochs", F.round(epochs, 6)).withColumn("full", F.floor("epochs").cast("int"))
    placed = blocks.join(weighted, F.col("source").eqNullSafe(F.col("same")))
    each = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full"))))
    # A source has at most BLOCKS rows an epoch, whatever its number of documents.
    ordered = F.array_sort(F.collect_list(F.struct(F.xxhash64("source", "epoch", "block").alias("h"), "block", "tokens"))).alias("order")
    ordered = each.groupBy("source", "weight", "epochs", "full", "total", "epoch").agg(ordered)
    part = F.when(F.col("epoch") < F.col("full"), F.col("total").cast("double")).otherwise((F.col("epochs") - F.col("full")) * F.col("total"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("blocks"))

    def taken(held: Column, one: Column) -> Column:
        fits = (F.col("epoch") < F.col("full")) | (held["used"] + one["tokens"] / 2.0 < part)
        more = F.struct((held["used"] + one["tokens"]).alias("used"), F.concat(held["blocks"], F.array(one["block"])).alias("blocks"))
        return F.when(fits, more).otherwise(held)

    chosen = ordered.withColumn("blocks", F.aggregate("order", start, taken)["blocks"])
    return chosen.select("source", "weight", "epochs", "epoch", F.posexplode("blocks").alias("place", "block"))


def drawn(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, n_tokens, block, weight, epochs, copies, places of every document: how often it
    is drawn, and the place of its block in every epoch that draws it.

    Rows that repeat are drawn alike; an empty table gives no rows; other columns aren't looked at.
    """
    plan = written(draws(docs, **options), "draws")
    by_block = plan.groupBy("source", "block").agg(F.count(F.lit(1)).cast("int").alias("copies"), F.array_sort(F.collect_list(F.struct("epoch", "place"))).alias("places"))
    weights = plan.groupBy("source").agg(F.first("weight").alias("weight"), F.first("epochs").alias("epochs"))
    rows = docs.select("doc_id", "source", _tokens("text").alias("n_tokens"), _block("doc_id").alias("block"))
    by_block = by_block.withColumnsRenamed({"source": "same", "block": "held"})
    rows = rows.join(by_block, F.col("source").eqNullSafe(F.col("same")) & (F.col("block") == F.col("held")), "left").drop("same", "held")
    rows = rows.join(weights.withColumnRenamed("source", "same"), F.col("source").eqNullSafe(F.col("same")), "left")
    places = F.coalesce("places", F.array().cast("array<struct<epoch:int,place:int>>"))
    return rows.select("doc_id", "source", "n_tokens", "block", "weight", "epochs", F.coalesce("copies", F.lit(0)).alias("copies"), places.alias("places"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", epoch: str | None = None, place: str | None = None, **options) -> DataFrame:
    """The documents as often as they are drawn, with their own columns, whatever these are called.

    ``epoch`` and ``place`` name further columns for the order to read them in: by epoch, then place.
    """
    same, block, turn, at = free_names(docs, "same", "block", "epoch", "place")
    plan = written(draws(docs, doc_id=doc_id, source=source, **options), "draws")
    plan = plan.select(F.col("source").alias(same), F.col("block").alias(block), F.col("epoch").alias(turn), F.col("place").alias(at))
    joined = docs.join(plan, F.col(source).eqNullSafe(F.col(same)) & (_block(doc_id) == F.col(block)))
    order = [F.col(c).alias(name) for c, name in ((turn, epoch), (at, place)) if name]
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), *order)
