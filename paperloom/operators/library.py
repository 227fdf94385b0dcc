"""The library: shelves, names and search over collections of papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The shelves that are always there, and the marks in a title that put a collection on one,
# in the order they are tried.
SHELVES = {"mock": "原创模拟卷", "past": "历年真题", "practice": "专项练习", "other": "其他"}
MARKS = {"mock": "模拟|原创", "past": "真题", "practice": "专项|练习|诊断|题库|训练"}
NAME_LIMIT = 30
PAPER_SCORE = 100


def display_name(override: Column, own: Column) -> Column:
    """The name a user gave, else its own."""
    return F.coalesce(F.nullif(override, F.lit("")), own)


def shelves(custom: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shelves, rejects) after requests for new shelves in order of ``seq``.

    ``custom``: owner, shelf_id, name, which may rename a default shelf; ``requests``: owner, seq, name. Every
    owner has the default shelves. Names are trimmed, of 1 to 30 characters, and differ in more than case
    from those that are there. Rejects: owner, seq, reason ('name' or 'taken')."""
    owners = custom.select("owner").unionByName(requests.select("owner")).distinct()
    pairs = F.array(*[F.struct(F.lit(k).alias("shelf_id"), F.lit(v).alias("default_name")) for k, v in SHELVES.items()])
    defaults = owners.select("owner", F.inline(pairs))
    held = defaults.join(custom, ["owner", "shelf_id"], "full").select("owner", "shelf_id", F.coalesce("name", "default_name").alias("name"))
    named = requests.withColumn("name", F.trim("name")).withColumn("folded", F.lower("name"))
    sized = F.coalesce(F.length("name").between(1, NAME_LIMIT), F.lit(False))
    used = held.select("owner", F.lower("name").alias("folded"), F.lit(True).alias("used")).distinct()
    first = named.filter(sized).groupBy("owner", "folded").agg(F.min("seq").alias("first_seq"))
    judged = named.join(used, ["owner", "folded"], "left").join(first, ["owner", "folded"], "left")
    reason = F.when(~sized, "name").when(F.coalesce("used", F.lit(False)) | (F.col("seq") > F.col("first_seq")), "taken")
    judged = judged.withColumn("reason", reason)
    made = judged.filter("reason IS NULL").select("owner", F.concat(F.lit("shelf-"), F.col("seq").cast("string")).alias("shelf_id"), "name")
    return held.unionByName(made), judged.filter("reason IS NOT NULL").select("owner", "seq", "reason")


def category_of(collections: DataFrame, known: list[str]) -> DataFrame:
    """``collections`` with ``category`` and ``category_manual``: the override if it is one of the ``known`` shelves,
    else by the marks in title and file name. ``collections``: …, title, file_name, override_category."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("file_name", F.lit("")))
    manual = F.coalesce(F.col("override_category").isin(known), F.lit(False))
    by_marks = F.when(text.rlike(MARKS["mock"]), "mock").when(text.rlike(MARKS["past"]), "past").when(text.rlike(MARKS["practice"]), "practice").otherwise("other")
    return collections.withColumns({"category": F.when(manual, F.col("override_category")).otherwise(by_marks), "category_manual": manual})


def list_collections(collections: DataFrame, papers: DataFrame, hidden: DataFrame) -> DataFrame:
    """``collections`` that can be seen, with ``paper_count`` and ``question_count`` of their visible papers: neither
    hidden nor superseded, with a visible paper. ``collections``: collection_id, superseded, …; ``papers``:
    paper_id, collection_id, question_count; ``hidden``: item_id. Order them by ``updated_at`` descending."""
    away = hidden.select("item_id").distinct()
    seen = papers.join(away, papers["paper_id"] == away["item_id"], "left_anti")
    counts = seen.groupBy("collection_id").agg(F.count(F.lit(1)).alias("paper_count"), F.sum(F.coalesce("question_count", F.lit(0))).cast("bigint").alias("question_count"))
    open_ = collections.filter(~F.coalesce("superseded", F.lit(False)))
    return open_.join(away, open_["collection_id"] == away["item_id"], "left_anti").join(counts, "collection_id")


def library_search(listed: DataFrame, papers: DataFrame, category: str = "all", term: str = "") -> DataFrame:
    """``facet, value, collections, papers, questions, score``: the row ``found`` sums up the listed collections of
    ``category`` that have ``term`` in a title, file name or paper's title, whatever its case; rows ``category``
    count all listed ones by category. ``listed``: collection_id, title, file_name, category, paper_count,
    question_count; ``papers``: collection_id, paper_title. A term is looked for within each name."""
    wanted = F.lit(term.strip().lower())
    has = lambda c: F.coalesce(F.contains(F.lower(c), wanted), F.lit(False))
    by_paper = papers.filter(has(F.col("paper_title"))).select("collection_id", F.lit(True).alias("in_paper")).distinct()
    rows = listed.join(by_paper, "collection_id", "left")
    match = F.lit(not term.strip()) | has(F.col("title")) | has(F.col("file_name")) | F.coalesce("in_paper", F.lit(False))
    found = match & (F.lit(category == "all") | (F.col("category") == category))
    facets = F.array(F.struct(F.lit("category").alias("facet"), F.col("category").alias("value")), F.struct(F.lit("category").alias("facet"), F.lit("all").alias("value")), F.when(found, F.struct(F.lit("found").alias("facet"), F.lit(category).alias("value"))))
    spread = rows.select(F.explode(F.array_compact(facets)).alias("f"), "paper_count", "question_count")
    counts = spread.groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("collections"), F.sum("paper_count").alias("papers"), F.sum("question_count").alias("questions"))
    return counts.withColumn("score", F.col("papers") * PAPER_SCORE)
