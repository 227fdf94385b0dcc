"""Papers to rows. A paper is one nested document; every operator here is shuffle-free
unless it summarises whole papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx

# Page order of section kinds.
CET4_ORDER = ["writing", "listening", "wordbank", "matching", "reading", "translation", "other"]
PAGE_ORDER = [
    "choice", "listening", "cloze", "wordbank", "translation", "matching", "reading", "writing", "other",
]


def sections(papers: DataFrame) -> DataFrame:
    """One row per section (``section_index`` from 0); a paper without sections keeps one empty row."""
    return papers.select(
        F.col("id").alias("paper_id"), F.posexplode_outer("sections").alias("section_index", "section")
    ).select(
        "paper_id",
        "section_index",
        F.col("section.id").alias("section_id"),
        F.col("section.title").alias("title"),
        F.col("section.total_score").alias("total_score"),
        F.col("section.score").alias("score"),
    )


def groups(papers: DataFrame) -> DataFrame:
    """One row per passage group."""
    exploded = papers.select(
        F.col("id").alias("paper_id"), F.posexplode("sections").alias("section_index", "section")
    ).select("paper_id", "section_index", F.posexplode("section.groups").alias("group_index", "g"))
    return exploded.select(
        "paper_id",
        "section_index",
        "group_index",
        F.col("g.title").alias("title"),
        F.size("g.questions").alias("n_questions"),
    )


def _owned(section: Column, index: Column) -> Column:
    """Questions of a section with their place; groups own the questions when there are any."""
    def placed(qs: Column, group: Column) -> Column:
        return F.transform(
            qs,
            lambda q: F.struct(
                index.cast("int").alias("section_index"),
                section["title"].alias("section_title"),
                section["type"].alias("section_type"),
                section["score"].alias("section_score"),
                section["description"].alias("section_description"),
                group.alias("grp"),
                q.alias("q"),
            ),
        )

    def as_group(i: Column | None, title: Column, description: Column, siblings: Column) -> Column:
        return F.struct(
            (i.cast("int") if i is not None else F.lit(None).cast("int")).alias("group_index"),
            title.alias("title"),
            description.alias("description"),
            F.transform(siblings, lambda q: F.coalesce(tx.blank_to_null(q["id"]), q["number"])).alias("sibling_ids"),
        )

    gs = section["groups"]
    from_groups = F.flatten(
        F.transform(gs, lambda g, i: placed(g["questions"], as_group(i, g["title"], g["description"], g["questions"])))
    )
    alone = as_group(
        None, F.lit(None).cast("string"), F.lit(None).cast("string"), section["questions"]
    )
    return F.when(F.size(gs) > 0, from_groups).otherwise(placed(section["questions"], alone))


def placed_questions(papers: DataFrame) -> DataFrame:
    """One row per owned question with its running ``position`` in the paper."""
    per_section = F.transform(F.col("sections"), lambda s, i: _owned(s, i))
    present = F.filter(per_section, lambda a: a.isNotNull())
    return papers.select(
        F.col("id").alias("paper_id"), F.posexplode(F.flatten(present)).alias("position", "item")
    ).select("paper_id", "position", "item.*")


def questions(papers: DataFrame) -> DataFrame:
    return placed_questions(papers).select(
        "paper_id",
        "section_index",
        F.col("grp.group_index").alias("group_index"),
        "position",
        F.col("q.id").alias("question_id"),
        F.col("q.number").alias("number"),
        F.col("q.type").alias("type"),
        F.col("q.stem").alias("stem"),
    )


def normalized_options(options: Column) -> Column:
    """Missing ids become A, B, C… by place; texts are trimmed."""
    letter = lambda i: F.chr(i + 65)
    return F.transform(
        options,
        lambda o, i: F.struct(
            F.coalesce(F.when(o["id"] != "", o["id"]), letter(i)).alias("id"),
            tx.strip(F.coalesce(o["text"], F.lit(""))).alias("text"),
        ),
    )


def normalize_options(papers: DataFrame) -> DataFrame:
    """Question rows with their options as ``id=text`` pairs in order."""
    pairs = F.transform(normalized_options(F.col("q.options")), lambda o: F.concat(o["id"], F.lit("="), o["text"]))
    return placed_questions(papers).select(
        "paper_id", "position", F.array_join(pairs, "|").alias("options")
    )


def options(papers: DataFrame) -> DataFrame:
    """One row per option."""
    return (
        placed_questions(papers)
        .select("paper_id", "position", F.posexplode(normalized_options(F.col("q.options"))).alias("option_index", "o"))
        .select(
            "paper_id", "position", "option_index",
            F.col("o.id").alias("option_id"), F.col("o.text").alias("text"),
        )
    )


def normalize_questions(papers: DataFrame) -> DataFrame:
    """Defaults for id, number and type; trimmed stem; page numbers that are whole numbers."""
    running = (F.col("position") + 1).cast("string")
    pages = F.filter(
        F.transform(F.col("q.source_pages"), lambda p: p.try_cast("int")), lambda p: p.isNotNull()
    )
    given = lambda c: F.when(c != "", c)
    return placed_questions(papers).select(
        "paper_id",
        "position",
        F.coalesce(given(F.col("q.id")), F.concat(F.lit("q"), running)).alias("question_id"),
        F.coalesce(given(F.col("q.number")), running).alias("number"),
        F.coalesce(given(F.col("q.type")), F.lit("unknown")).alias("type"),
        tx.strip(F.coalesce(F.col("q.stem"), F.lit(""))).alias("stem"),
        F.array_join(F.coalesce(pages, F.array().cast("array<int>")).cast("array<string>"), ",").alias("source_pages"),
    )


def question_contexts(papers: DataFrame) -> DataFrame:
    """Section title, reading context, both context keys and the sibling questions."""
    group = F.col("grp.group_index")
    ledger_tail = F.when(group.isNotNull(), F.concat(F.lit(":group-"), group.cast("string"))).otherwise(F.lit(""))
    grading_tail = F.when(group.isNotNull(), F.concat(F.lit("-group-"), (group + 1).cast("string"))).otherwise(F.lit(""))
    return placed_questions(papers).select(
        "paper_id",
        F.coalesce(tx.blank_to_null(F.col("q.id")), F.col("q.number"), F.lit("")).alias("question_id"),
        "section_title",
        tx.join_parts(F.col("section_description"), F.col("grp.description")).alias("context_text"),
        F.concat(
            F.col("paper_id"), F.lit(":section-"), F.col("section_index").cast("string"), ledger_tail
        ).alias("context_key"),
        F.concat(F.lit("section-"), (F.col("section_index") + 1).cast("string"), grading_tail).alias("grading_key"),
        F.array_join("grp.sibling_ids", ",").alias("sibling_ids"),
    ).filter(F.col("question_id") != "")


def section_labels(section_rows: DataFrame, title: str = "section_title") -> DataFrame:
    """Kind, key, canonical key and part number of every section title (ASCII titles)."""
    t = F.col(title)
    return section_rows.select(
        "paper_id",
        "section_no",
        tx.section_kind(t).alias("kind"),
        tx.section_key(t).alias("section_key"),
        tx.canonical_section_key(t).alias("canonical_key"),
        tx.part_number(t).alias("part_number"),
    )


def exam_layout(papers: DataFrame, section_rows: DataFrame) -> DataFrame:
    """Page plan of each paper: one page per kind in the standard layout, else one per section."""
    kinds = section_rows.select(
        "paper_id", "section_no", "n_questions", tx.section_kind(F.col("section_title")).alias("kind")
    )

    def total(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("n_questions")).otherwise(0))

    shape = kinds.groupBy("paper_id").agg(
        (
            (total("choice") == 20) & (total("cloze") == 20) & (total("reading") > 0)
            & (total("translation") > 0) & (total("writing") == 1) & (F.sum("n_questions") == 54)
        ).alias("by_counts")
    )
    layout = (
        papers.select("paper_id", "exam_format")
        .join(shape, "paper_id")
        .select(
            "paper_id",
            "exam_format",
            (F.coalesce(F.col("exam_format").isin("cet4", "degree"), F.lit(False)) | F.col("by_counts")).alias("standard"),
        )
    )

    def rank(order: list[str]) -> Column:
        return F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))

    ranked = kinds.join(layout, "paper_id").withColumn(
        "slot",
        F.when(~F.col("standard"), F.col("section_no").cast("bigint"))
        .when(F.col("exam_format") == "cet4", rank(CET4_ORDER))
        .otherwise(rank(PAGE_ORDER)),
    )
    pages = (
        ranked.filter(F.col("slot") > 0)
        .groupBy("paper_id", "standard", "slot", "kind")
        .agg(F.sum("n_questions").alias("n_questions"))
    )
    # A paper has at most a few pages: one per kind or section.
    place = Window.partitionBy("paper_id").orderBy("slot")
    return pages.withColumn("page_no", F.row_number().over(place)).select(
        "paper_id", "standard", "page_no", "kind", "n_questions"
    )


def paper_counts(section_rows: DataFrame) -> DataFrame:
    """Questions, part numbers and whether any section is empty or worth nothing."""
    part = F.when(tx.part_number(F.col("section_title")) != "", tx.part_number(F.col("section_title")))
    weak = (F.col("n_questions") == 0) | (F.col("score") <= 0) | (F.col("total_score") <= 0)
    return section_rows.groupBy("paper_id").agg(
        F.sum("n_questions").alias("question_count"),
        F.array_join(F.array_sort(F.collect_set(part)), ",").alias("part_numbers"),
        F.max(weak).alias("weak"),
    )


def select_better_paper(standard: DataFrame, current: DataFrame) -> DataFrame:
    """Which parse to keep per paper; both inputs are :func:`paper_counts` plus ``exam_format``."""
    parts = ["1", "2", "3", "4", "5"]

    def complete(c: Column) -> Column:
        held = F.split(c, ",")
        return F.size(F.array_except(F.array(*[F.lit(p) for p in parts]), held)) == 0

    joined = standard.alias("s").join(current.alias("c"), "paper_id")
    use_standard = (
        F.when(F.col("s.exam_format") == "cet4", True)
        .when((F.col("s.question_count") < 50) | ~complete(F.col("s.part_numbers")), False)
        .when(F.col("s.question_count") != F.col("c.question_count"), True)
        .when(~complete(F.col("c.part_numbers")), True)
        .otherwise(F.col("c.weak"))
    )
    return joined.select("paper_id", use_standard.alias("use_standard"))
