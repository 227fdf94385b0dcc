"""Structural checks. Every check gives issue rows in long form:

``paper_id, code, severity, section, number, page`` – one row per concerned number and page,
so that no issue has to gather all its pages in one place.

Question rows: ``paper_id, section_no, section_title, group_no, position, page, question_id,
number, type, stem, options array<struct<id,text>>``. Source lines: ``paper_id, page, line_no, line``.
Rows of questions, sections and passages may also have a ``section_type``: where it isn't empty, the
kind of the section is the kind that it names, not its title's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.scans import Running, running
from .pages import LINES_PER_BLOCK, numbered_blocks, scope_lines

ISSUE = ["paper_id", "code", "severity", "section", "number", "page"]

# Codes, and the kinds a check applies to.
PASSAGE_KINDS = ["reading", "cloze", "wordbank", "matching"]
STEMLESS_KINDS = ["listening", "cloze", "wordbank"]
PLACEHOLDER = r"(?i)^(?:第?\s*\d+\s*题|题目\s*\d+|Question\s*\d+|\[无法识别\])(?:[。.:：\s]*)$"
DECLARED = r"共\s*(?:\d+\s*篇\s*[、,，]?\s*)?(\d+)\s*题"
SEGMENT_END = r"(?i)^\s*(?:Section\s+[A-Z]|Directions|Questions\s+\d|Passage\s+\w+)"


def _given(rows: DataFrame, column: str) -> Column:
    return F.col(column) if column in rows.columns else F.lit(None).cast("string")


def kind_of(rows: DataFrame) -> Column:
    """Kind of a row's section, by its type before its title."""
    given = _given(rows, "section_type")
    return tx.section_kind(F.when(given != "", given).otherwise(F.col("section_title")))


def key_of(rows: DataFrame) -> Column:
    return tx.section_key(F.col("section_title"), _given(rows, "section_type"))


def issues(df: DataFrame, code: str, severity: str | Column, section=None, number=None, page=None) -> DataFrame:
    pick = lambda c, kind: (F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c).cast(kind)
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(
        "paper_id",
        F.lit(code).alias("code"),
        level.alias("severity"),
        F.coalesce(pick(section, "string"), F.lit("")).alias("section"),
        pick(number, "string").alias("number"),
        pick(page, "bigint").alias("page"),
    )


def combine(frames: list[DataFrame]) -> DataFrame:
    """All issues; exact duplicates count once."""
    return reduce(DataFrame.unionByName, frames).dropDuplicates(ISSUE)


def pdf_requires_vision(pages: DataFrame) -> DataFrame:
    return issues(pages.filter("extraction_method = 'pdf_text'"), "pdf_requires_vision", "error", page="page")


def empty_section(sections: DataFrame, questions: DataFrame) -> DataFrame:
    found = questions.select("paper_id", "section_no").distinct()
    return issues(sections.join(found, ["paper_id", "section_no"], "left_anti"), "empty_section", "warning", "section_title")


def duplicate_id(questions: DataFrame) -> DataFrame:
    """Missing ids, and every repetition of an id after its first use in the paper."""
    first = questions.groupBy("paper_id", "question_id").agg(F.min("position").alias("first_position"))
    missing = F.coalesce(F.col("question_id"), F.lit("")) == ""
    named = questions.filter(~missing).join(first, ["paper_id", "question_id"]).filter("position > first_position")
    return combine([
        issues(questions.filter(missing), "duplicate_id", "error", "section_title", "number", "page"),
        issues(named, "duplicate_id", "error", "section_title", "number", "page"),
    ])


def duplicate_number(questions: DataFrame) -> DataFrame:
    """Repeated number in a section key; an error when the stem repeats the one before."""
    keyed = questions.select(
        "paper_id", "section_title", "number", "position", "page",
        key_of(questions).alias("section_key"),
        F.regexp_replace(F.coalesce("stem", F.lit("")), r"(?U)\s+", "").alias("packed"),
    )
    # A question on several pages is one question; its pages come back as rows at the end.
    keyed = keyed.groupBy("paper_id", "section_title", "section_key", "number", "position").agg(
        F.first("packed").alias("packed"), F.sort_array(F.collect_set("page")).alias("pages")
    )
    previous = running(
        keyed, ["paper_id", "section_key", "number"], ["position"], F.floor(F.col("position") / LINES_PER_BLOCK),
        {"before": Running("last", F.col("packed"), inclusive=False)},
    ).filter(F.col("before").isNotNull())
    level = F.when(F.col("before") == F.col("packed"), "error").otherwise("warning")
    previous = previous.withColumn("page", F.explode_outer("pages"))
    return issues(previous, "duplicate_number", level, "section_title", "number", "page")


def missing_options(questions: DataFrame) -> DataFrame:
    few = F.coalesce(F.size("options"), F.lit(0)) < 2
    choice = F.col("type").isin("single_choice", "multiple_choice")
    return issues(questions.filter(choice & few), "missing_options", "error", "section_title", "number", "page")


def invalid_options(questions: DataFrame) -> DataFrame:
    ids = F.transform("options", lambda o: o["id"])
    repeated = F.size(F.array_distinct(ids)) != F.size(ids)
    blank = F.exists("options", lambda o: tx.strip(F.coalesce(o["text"], F.lit(""))) == "")
    return issues(questions.filter(repeated | blank), "invalid_options", "error", "section_title", "number", "page")


def missing_stem(questions: DataFrame) -> DataFrame:
    needs = ~kind_of(questions).isin(*STEMLESS_KINDS)
    blank = tx.strip(F.coalesce("stem", F.lit(""))) == ""
    return issues(questions.filter(needs & blank), "missing_stem", "error", "section_title", "number", "page")


def placeholder_stem(questions: DataFrame) -> DataFrame:
    needs = ~kind_of(questions).isin(*STEMLESS_KINDS)
    hit = tx.strip(F.coalesce("stem", F.lit(""))).rlike(PLACEHOLDER)
    return issues(questions.filter(needs & hit), "placeholder_stem", "error", "section_title", "number", "page")


def missing_passage(passages: DataFrame, questions: DataFrame) -> DataFrame:
    """Passages that are shorter than 60 characters without their directions.

    ``passages``: ``paper_id, section_no, section_title, group_no, description``; where the last is
    empty, a ``section_description`` counts.
    """
    text = F.coalesce(F.when(F.col("description") != "", F.col("description")), _given(passages, "section_description"), F.lit(""))
    body = tx.strip(F.regexp_replace(text, r"(?is)^Directions?\s*[:：].*?(?:\n\s*\n|$)", ""))
    short = passages.filter(kind_of(passages).isin(*PASSAGE_KINDS) & (F.length(body) < 60))
    keys = ["paper_id", "section_no", "group_no"]
    on = questions.select(*keys, "page").distinct().withColumnsRenamed({k: f"q_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"q_{k}")) for k in keys])
    return issues(short.join(on, cond, "left"), "missing_passage", "warning", "section_title", page="page")


def section_score(sections: DataFrame) -> DataFrame:
    n = F.col("n_questions").cast("decimal(12,3)")
    score, total = F.col("score").cast("decimal(12,2)"), F.col("total_score").cast("decimal(12,2)")
    allowed = F.greatest(F.lit(0.11).cast("decimal(12,3)"), F.lit(0.011).cast("decimal(12,3)") * n)
    off = (score != 0) & (F.abs(score * n - total) > allowed)
    return issues(sections.filter(off), "section_score", "warning", "section_title")


def no_questions(papers: DataFrame, questions: DataFrame) -> DataFrame:
    return issues(papers.join(questions.select("paper_id").distinct(), "paper_id", "left_anti"), "no_questions", "error")


def total_score(papers: DataFrame, sections: DataFrame) -> DataFrame:
    sums = sections.groupBy("paper_id").agg(F.sum(F.col("total_score").cast("decimal(12,2)")).alias("parts"))
    joined = papers.select("paper_id", F.col("total_score").cast("decimal(12,2)").alias("whole")).join(sums, "paper_id", "left")
    zero = F.lit(0).cast("decimal(12,2)")
    off = F.abs(F.coalesce("parts", zero) - F.coalesce("whole", zero)) > F.lit(0.11).cast("decimal(12,2)")
    return issues(joined.filter(off), "total_score", "error")


class Source:
    """Source lines by part, what they lead one to expect, and what the paper holds.

    ``lines`` are scanned once; the numbers and pages found are small beside the texts.
    """

    def __init__(self, lines: DataFrame, questions: DataFrame):
        self.lines = scope_lines(lines)
        self.questions = questions
        kind = kind_of(questions)
        pooled = F.when(kind.isin("wordbank", "matching"), F.lit("reading")).otherwise(kind)
        self.actual = (
            questions.select(
                "paper_id", "number",
                F.explode(F.array(key_of(questions), F.concat(F.lit("kind-"), pooled))).alias("held_as"),
            )
            .distinct()
        )
        scopes = self.lines.groupBy("paper_id", "scope").agg(F.max_by("scope_kind", F.when(F.col("scope_kind").isNotNull(), F.col("line_no"))).alias("scope_kind"))
        held = self.actual.select("paper_id", "held_as").distinct()
        by_key = held.select("paper_id", F.col("held_as").alias("scope"), F.lit(True).alias("by_key"))
        by_kind = held.select("paper_id", F.col("held_as").alias("kind_ref"), F.lit(True).alias("by_kind"))
        # Where the numbers of a scope are looked up: its own part, else its kind, else nowhere.
        self.scopes = (
            scopes.withColumn("kind_ref", F.concat(F.lit("kind-"), F.col("scope_kind")))
            .join(by_key, ["paper_id", "scope"], "left")
            .join(by_kind, ["paper_id", "kind_ref"], "left")
            .select(
                "paper_id", "scope", "scope_kind",
                F.when(F.col("by_key"), F.col("scope")).when(F.col("by_kind"), F.col("kind_ref")).alias("held_as"),
            )
        )

    def scope_pages(self) -> DataFrame:
        return self.lines.select("paper_id", "scope", "page").distinct()

    def expected(self) -> DataFrame:
        """Numbers the source shows, with their pages; bullets of a writing outline do not count."""
        outline = (
            self.lines.filter((F.col("scope_kind") == "writing") & F.col("line").rlike(r"(?i)\boutline\b|提纲|要点"))
            .groupBy("paper_id", "scope")
            .agg(F.min("line_no").alias("outline_line"))
        )
        numbered = F.regexp_extract("line", r"^\s*(\d{1,3})\s*[.、]\s+\S", 1)
        lines = (
            self.lines.withColumn("n", numbered)
            .filter(F.col("n") != "")
            .join(outline, ["paper_id", "scope"], "left")
            .filter(F.col("outline_line").isNull() | (F.col("line_no") <= F.col("outline_line")))
            .select("paper_id", "scope", F.col("n").alias("number"), "page")
        )
        return lines.unionByName(self.blanks()).distinct()

    def blanks(self) -> DataFrame:
        found = F.regexp_extract_all("line", F.lit(r"_+\s*(\d{1,3})\s*_+"), F.lit(1))
        return self.lines.select("paper_id", "scope", "page", F.explode(found).alias("number")).select(
            "paper_id", "scope", "number", "page"
        )

    def missing(self) -> DataFrame:
        known = self.scopes.filter(F.col("held_as").isNotNull())
        return (
            self.expected().join(known, ["paper_id", "scope"])
            .join(self.actual, ["paper_id", "held_as", "number"], "left_anti")
            .select("paper_id", "scope", "scope_kind", "number", "page")
        )

    def option_blocks(self) -> DataFrame:
        """Numbered source items that show all of A–D."""
        keys = ["paper_id", "scope"]
        blocks = numbered_blocks(self.lines, keys, 0, 999)
        item = [*keys, "start_line", "number"]
        cuts = blocks.filter(F.col("line").rlike(SEGMENT_END)).groupBy(*item).agg(F.min("line_no").alias("cut"))
        labels = F.explode(F.regexp_extract_all("line", F.lit(r"(?U)(?<!\w)([A-D])\s*[).、]\s*"), F.lit(1)))
        return (
            blocks.join(cuts, item, "left")
            .filter(F.col("cut").isNull() | (F.col("line_no") < F.col("cut")))
            .select(*item, labels.alias("label"))
            .distinct()
            .groupBy(*item)
            .agg(F.count("*").alias("labels"))
            .filter(F.col("labels") == 4)
            .select(*keys, F.col("number").cast("string").alias("number"))
            .distinct()
        )


def declared_question_count(source: Source) -> DataFrame:
    """``共 … N 题`` in a scope against the distinct numbers found for it."""
    declared = (
        source.lines.withColumn("d", F.regexp_extract("line", DECLARED, 1).try_cast("int"))
        .filter(F.col("d").isNotNull())
        .groupBy("paper_id", "scope")
        .agg(F.min_by("d", "line_no").alias("declared"))
        .join(source.scopes, ["paper_id", "scope"])
    )
    counts = source.actual.groupBy("paper_id", "held_as").agg(F.count("*").alias("found"))
    off = declared.join(counts, ["paper_id", "held_as"], "left").filter(F.coalesce("found", F.lit(0)) != F.col("declared"))
    return issues(off.join(source.scope_pages(), ["paper_id", "scope"]), "declared_question_count", "error", "scope", page="page")


def missing_writing_prompt(source: Source, sections: DataFrame) -> DataFrame:
    """Writing topic of the source that is not kept in the writing section.

    ``sections``: ``paper_id, section_no, section_title, description``.
    """
    writing = source.lines.filter("scope_kind = 'writing'").select("paper_id", "scope", "page", "line_no", "line")
    keys = ["paper_id", "scope"]
    opens = writing.filter(F.col("line").rlike(r"(?i)\btopic\s*[:：]")).groupBy(*keys).agg(F.min("line_no").alias("opens"))
    after = writing.join(opens, keys).filter(F.col("line_no") >= F.col("opens"))
    ends = F.when(F.col("line_no") == F.col("opens"), F.col("line").rlike(r"(?i)\btopic\s*[:：].*\.(?:\s|$)")).otherwise(
        F.col("line").rlike(r"\.(?:\s|$)|^\s*$")
    )
    closes = after.filter(ends).groupBy(*keys).agg(F.min("line_no").alias("closes"))
    topic_text = (
        after.join(closes, keys, "left")
        .filter(F.col("closes").isNull() | (F.col("line_no") <= F.col("closes")))
        .groupBy(*keys)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("t"))
    )
    topic = F.regexp_extract("t", r"(?is)\btopic\s*[:：]\s*(.+?)(?:\.(?:\s|$)|\n\s*\n|$)", 1)
    topics = topic_text.select(*keys, topic.alias("topic")).filter(F.col("topic") != "")
    is_writing = tx.section_kind(F.col("section_title")) == "writing"
    with_key = lambda df: df.withColumn("section_key", key_of(df)).withColumn("is_writing", is_writing)
    pieces = with_key(sections).select("paper_id", "section_key", "is_writing", "section_no", F.lit(-1).cast("bigint").alias("position"), F.col("description").alias("piece")).unionByName(
        with_key(source.questions).select("paper_id", "section_key", "is_writing", "section_no", F.col("position").cast("bigint").alias("position"), F.col("stem").alias("piece"))
    )
    kept = (
        topics.join(pieces, "paper_id")
        .filter((F.col("section_key") == F.col("scope")) | F.col("is_writing"))
        .groupBy(*keys, "topic")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_no", "position", "piece"))), lambda s: F.coalesce(s["piece"], F.lit(""))), "\n").alias("kept"))
    )
    held = kept.filter(tx.compact(F.col("kept")).contains(tx.compact(F.col("topic")))).select(*keys)
    lost = topics.join(held, keys, "left_anti")
    return issues(lost.join(source.scope_pages(), keys), "missing_writing_prompt", "error", "scope", page="page")


def unmatched_source(source: Source) -> DataFrame:
    nowhere = source.scopes.filter(F.col("held_as").isNull()).select("paper_id", "scope")
    return issues(source.expected().join(nowhere, ["paper_id", "scope"]), "unmatched_source", "warning", number="number", page="page")


def missing_numbers(source: Source) -> DataFrame:
    return issues(source.missing(), "missing_numbers", "warning", "scope", "number", "page")


def missing_blanks(source: Source) -> DataFrame:
    explicit = source.blanks().select("paper_id", "scope", "number").distinct()
    return issues(source.missing().join(explicit, ["paper_id", "scope", "number"], "left_semi"), "missing_blanks", "error", "scope", "number", "page")


def passage_coverage(lines: DataFrame, material: DataFrame) -> DataFrame:
    """Share of the source's long words that the kept passages hold, where it is below 0.55.

    ``lines`` are scoped source lines; ``material``: ``paper_id, section_key, kind, description``.
    """
    prose = lines.filter(
        F.col("scope_kind").isin("reading", "cloze")
        & (F.size(F.split(tx.strip(F.col("line")), r"\s+")) > 12)
        & ~F.col("line").rlike(r"^\s*(?:\d+[.、]|[A-D][).])")
    )
    word = lambda c, p: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(p), F.lit(0))))
    held = F.when(F.col("kind").isin("reading", "wordbank", "matching"), "reading").otherwise(F.col("kind"))
    # Both sides meet in one grouping by word; what is gathered of a word is the few parts that hold it.
    source_words = prose.select("paper_id", word(F.lower("line"), "[a-z]{5,}").alias("word"), F.struct("scope", "scope_kind").alias("part"))
    kept_words = material.select("paper_id", word(F.lower("description"), "[a-z]{5,}").alias("word"), held.alias("pool"), F.col("section_key").alias("key"))
    both = source_words.unionByName(kept_words, allowMissingColumns=True)
    met = both.groupBy("paper_id", "word").agg(*[F.collect_set(c).alias(f"{c}s") for c in ("part", "pool", "key")])
    spread = met.select("paper_id", "pools", "keys", F.explode("parts").alias("part"))
    hit = F.coalesce(F.array_contains("pools", F.col("part.scope_kind")), F.lit(False)) | F.coalesce(F.array_contains("keys", F.col("part.scope")), F.lit(False))
    low = (
        spread.groupBy("paper_id", F.col("part.scope").alias("scope"))
        .agg(F.count("*").alias("words"), F.count_if(hit).alias("kept"))
        .filter((F.col("words") > 60) & (F.col("kept") / F.col("words") < 0.55))
    )
    pages = lines.select("paper_id", "scope", "page").distinct()
    return issues(low.join(pages, ["paper_id", "scope"]), "passage_coverage", "warning", "scope", page="page")


def _candidates(source: Source) -> DataFrame:
    """Source items with A–D joined to the questions that could be theirs."""
    ids = F.transform("options", lambda o: o["id"])
    short = F.size(F.array_except(F.array(*[F.lit(x) for x in "ABCD"]), ids)) > 0
    q = source.questions.select(
        "paper_id", "number", key_of(source.questions).alias("section_key"),
        kind_of(source.questions).alias("kind"), F.coalesce(short, F.lit(True)).alias("short"),
    )
    kinds = source.scopes.select("paper_id", "scope", "scope_kind")
    return (
        source.option_blocks().join(kinds, ["paper_id", "scope"])
        .join(q, ["paper_id", "number"], "left")
        .withColumn("mine", F.coalesce((F.col("section_key") == F.col("scope")) | (F.col("kind") == F.col("scope_kind")), F.lit(False)))
        .groupBy("paper_id", "scope", "number")
        .agg(F.max("mine").alias("found"), F.max(F.col("mine") & F.col("short")).alias("short"))
    )


def _with_expected_pages(rows: DataFrame, source: Source) -> DataFrame:
    return rows.join(source.expected(), ["paper_id", "scope", "number"], "left")


def source_options(source: Source) -> DataFrame:
    lacking = _candidates(source).filter(F.coalesce("short", F.lit(False)))
    return issues(_with_expected_pages(lacking, source), "source_options", "error", "scope", "number", "page")


def confirmed_missing(source: Source) -> DataFrame:
    absent = _candidates(source).filter(~F.col("found")).select("paper_id", "scope", "number")
    return issues(source.missing().join(absent, ["paper_id", "scope", "number"]), "confirmed_missing", "error", "scope", "number", "page")


def extraction_warning(warnings: DataFrame) -> DataFrame:
    return issues(warnings, "extraction_warning", "error", page="page")


def no_source(papers: DataFrame, pages: DataFrame) -> DataFrame:
    return issues(papers.join(pages.select("paper_id").distinct(), "paper_id", "left_anti"), "no_source", "warning")


def limited_pages(papers: DataFrame) -> DataFrame:
    return issues(papers.filter("source_page_count > page_count"), "limited_pages", "warning")


def unconfirmed_format(papers: DataFrame) -> DataFrame:
    known = F.coalesce(F.col("exam_format").isin("cet4", "degree"), F.lit(False))
    return issues(papers.filter(~known), "unconfirmed_format", "warning")


def rollup(papers: DataFrame, issue_rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Status and question count per paper."""
    worst = issue_rows.groupBy("paper_id").agg(F.max(F.col("severity") == "error").alias("has_error"))
    counts = questions.groupBy("paper_id").agg(F.count("*").alias("question_count"))
    return (
        papers.select("paper_id").join(worst, "paper_id", "left").join(counts, "paper_id", "left")
        .select(
            "paper_id",
            F.when(F.col("has_error"), "incomplete").when(F.col("has_error").isNotNull(), "review").otherwise("ready").alias("status"),
            F.coalesce("question_count", F.lit(0)).alias("question_count"),
        )
    )


def question_issues(questions: DataFrame) -> DataFrame:
    """All checks that need only the questions."""
    return combine([
        duplicate_id(questions), duplicate_number(questions), missing_options(questions),
        invalid_options(questions), missing_stem(questions), placeholder_stem(questions),
    ])
