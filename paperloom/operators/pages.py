"""Recognised pages and lines to exam structure.

Pages are rows ``doc_id, page, text``; lines are rows ``<keys>, line_no, line``. State that
runs down a document (current part, open question, offsets) uses block scans, so that one
huge document does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.staging import staged
from ..functions import text as tx
from ..functions.answers import ratio
from ..functions.scans import Running, running

LINES_PER_BLOCK = 4096
PAGES_PER_BLOCK = 512
PAGES_PER_BIN = 64
CHARS_PER_BIN = 65536

_EXAM_START = r"(?i)Part\s*(?:I|Ⅰ|1)\s+Vocabulary\s+and\s+Structure"
_PART_HEADING = r"(?i)^[^A-Za-z0-9]{0,8}[ \t]*Part[ \t]+([IVXⅠⅡⅢⅣⅤⅥ]+|\d+)[ \t]+(.+)"
_PART_META = (
    r"(?iU)^\s*Part\s+([IVXⅠⅡⅢⅣⅤⅥ]+|\d+)\s+([^（(]*?)"
    r"(?:[（(]\s*([0-9]+)\s*minutes?\s*[,，]\s*([0-9]+(?:\.[0-9]+)?)\s*points?\s*[）)])?\s*$"
)
_SCOPE_HEADING = r"(?iU)^\s*Part\s+([IVX]+|\d+)\s+(.+)"
_NUMBER_LINE = r"(?U)^\s*([0-9]{1,3})\s*[.、](?:\s|$)"
_NUMBER_HEAD = r"(?U)^\s*([0-9]{1,3})\s*[.、]\s*"
_PASSAGE_LINE = r"(?i)^[^A-Za-z0-9]{0,8}(?:[A-D]\s+)?Passage\s+(\d+|One|Two|Three|Four)\b.*$"
_SENTENCE_MARKS = "[.!?。！？]"


def _line_block() -> Column:
    return F.floor(F.col("line_no") / LINES_PER_BLOCK)


def _page_block() -> Column:
    return F.floor(F.col("page") / PAGES_PER_BLOCK)


def clean_pages(pages: DataFrame) -> DataFrame:
    """Page texts without furniture lines."""
    return pages.select("doc_id", "page", tx.strip_page_artifacts(F.col("text")).alias("text"))


def cleaned_forms(pages: DataFrame) -> DataFrame:
    """Inline, paragraph and line-preserving clean forms."""
    t = F.col("text")
    return pages.select(
        "doc_id", "page",
        tx.clean_inline(t).alias("inline_text"),
        tx.clean_paragraphs(t).alias("paragraph_text"),
        tx.clean_lines(t).alias("line_text"),
    )


def split_exams(pages: DataFrame) -> DataFrame:
    """Page range of every exam in a document.

    A first-part heading opens an exam unless it is marked as continued or its numbering
    does not restart at 1; the first heading of a document always opens one.
    """
    tail = F.get(F.split(F.col("text"), _EXAM_START, 2), F.lit(1))
    first = F.regexp_extract(F.col("tail"), r"(?m)^\s*(\d+)\s*[.、]\s+", 1)
    headed = (
        pages.filter(F.col("text").rlike(_EXAM_START) & (F.col("page") > 0))
        .select("doc_id", "page", tail.alias("tail"))
        .select(
            "doc_id", "page",
            (F.col("tail").rlike(r"(?i)^[^\n]*(?:continued|续)") | ((first != "") & ~first.rlike("^0*1$"))).alias("continues"),
        )
    )
    opening = headed.groupBy("doc_id").agg(F.min("page").alias("first_page"))
    starts = (
        headed.join(opening, "doc_id")
        .filter(~F.col("continues") | (F.col("page") == F.col("first_page")))
        .select("doc_id", "page")
    )
    nexts = running(
        starts, ["doc_id"], ["page"], _page_block(),
        {"next_start": Running("last", F.col("page"), inclusive=False)}, reverse=True,
    )
    last = pages.groupBy("doc_id").agg(F.max("page").alias("last_page"))
    return nexts.join(last, "doc_id").select(
        "doc_id",
        F.col("page").alias("start_page"),
        F.coalesce(F.col("next_start") - 1, F.col("last_page")).alias("end_page"),
    )


def exam_title(pages: DataFrame) -> DataFrame:
    """Title line of a page, with its collection line when that follows directly."""
    lines = F.filter(F.transform(F.split(tx.strip_page_artifacts(F.col("text")), "\n"), tx.strip), lambda x: x != "")
    at = F.array_position(F.transform(F.col("lines"), lambda x: x.rlike(r"20\d{2}年.*学士学位英语考试")), True)
    follower = F.try_element_at("lines", F.col("at").cast("int") + 1)
    return (
        pages.select("doc_id", "page", lines.alias("lines"))
        .withColumn("at", at)
        .filter(F.col("at") > 0)
        .select(
            "doc_id", "page",
            F.concat_ws(
                " ", F.element_at("lines", F.col("at").cast("int")), F.when(follower.contains("真题汇编"), follower)
            ).alias("title"),
        )
    )


def scope_pages(exams: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of every exam range; a range that holds no page gets the whole document.

    The range join is an equi join on (document, page bin), so neither long documents nor
    many ranges are compared pair by pair.
    """
    keys = ["doc_id", "start_page", "end_page"]
    ranges = exams.select(*keys).distinct()
    page_bin = F.floor(F.col("page") / PAGES_PER_BIN)
    bounds = pages.groupBy("doc_id").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    # A range is cut to the pages that exist before it is spread over bins.
    spread = (
        ranges.join(bounds, "doc_id")
        .withColumn("lo", F.greatest("lo", "start_page"))
        .withColumn("hi", F.least("hi", "end_page"))
        .filter(F.col("lo") <= F.col("hi"))
        .withColumn(
            "bin",
            F.explode(F.sequence(F.floor(F.col("lo") / PAGES_PER_BIN), F.floor(F.col("hi") / PAGES_PER_BIN))),
        )
    )
    inside = (
        pages.select("doc_id", "page", page_bin.alias("bin"))
        .join(spread, ["doc_id", "bin"])
        .filter(F.col("page").between(F.col("start_page"), F.col("end_page")))
        .select(*keys, "page")
    )
    empty = ranges.join(inside.select(*keys).distinct(), keys, "left_anti")
    return inside.unionByName(empty.join(pages.select("doc_id", "page"), "doc_id").select(*keys, "page"))


def page_windows(pages: DataFrame, size: int = 2, step: int = 1) -> DataFrame:
    """Overlapping windows over the pages of a document, last window ending on the last page."""
    ranked = running(
        pages.select("doc_id", "page"), ["doc_id"], ["page"], _page_block(),
        {"place": Running("sum", F.lit(1), inclusive=False)},
    )
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    last = F.when(F.col("n") <= size, F.lit(0)).otherwise(F.ceil((F.col("n") - size) / step)).cast("bigint")
    lo = F.greatest(F.lit(0), F.floor((F.col("place") - size) / step) + 1)
    hi = F.least(F.floor(F.col("place") / step), last)
    return (
        ranked.join(counts, "doc_id")
        .withColumn("lo", lo.cast("bigint"))
        .withColumn("hi", hi.cast("bigint"))
        .filter(F.col("lo") <= F.col("hi"))
        .select("doc_id", F.explode(F.sequence(F.col("lo") + 1, F.col("hi") + 1)).alias("window_no"), "page")
    )


def clamp_exam_ranges(proposals: DataFrame, documents: DataFrame) -> DataFrame:
    """Proposed ranges cut to the document; a document without proposals is one exam.

    ``proposals``: ``doc_id, exam_no, start_page, end_page``; ``documents``: ``doc_id, n_pages``.
    """
    n = F.col("n_pages").cast("bigint")
    as_page = lambda name, default: F.coalesce(F.col(name).try_cast("double").try_cast("bigint"), default)
    start = F.greatest(F.lit(1).cast("bigint"), F.least(n, as_page("start_page", F.lit(1).cast("bigint"))))
    given = (
        proposals.join(documents, "doc_id")
        .withColumn("s", start)
        .select(
            "doc_id", F.col("exam_no").cast("bigint").alias("exam_no"), F.col("s").alias("start_page"),
            F.greatest(F.col("s"), F.least(n, as_page("end_page", n))).alias("end_page"),
        )
    )
    whole = documents.join(proposals.select("doc_id").distinct(), "doc_id", "left_anti").select(
        "doc_id", F.lit(1).cast("bigint").alias("exam_no"), F.lit(1).cast("bigint").alias("start_page"), n.alias("end_page")
    )
    return given.unionByName(whole)


def page_offsets(pages: DataFrame) -> DataFrame:
    """Character span of each page in the text that joins all pages with a blank line."""
    sized = pages.select("doc_id", "page", F.length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint").alias("size"))
    placed = running(
        sized, ["doc_id"], ["page"], _page_block(),
        {"start_pos": Running("sum", F.col("size") + 2, inclusive=False)},
    )
    return placed.select(
        "doc_id", "page", "start_pos", (F.col("start_pos") + F.col("size")).alias("end_pos")
    )


def pages_for_spans(spans: DataFrame, offsets: DataFrame) -> DataFrame:
    """Pages a text span overlaps; a span outside the text gets the first page.

    ``spans``: ``doc_id, span_id, span_start, span_end``. Both sides are cut into bins of
    the text, so the overlap join is an equi join.
    """
    def bins(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(lo) / CHARS_PER_BIN), F.floor(F.col(hi) / CHARS_PER_BIN)))

    real = offsets.filter(F.col("page") != 0)
    extent = real.groupBy("doc_id").agg(F.max("end_pos").alias("text_end"), F.min_by("page", "start_pos").alias("first_page"))
    clipped = (
        spans.join(extent.select("doc_id", "text_end"), "doc_id")
        .withColumn("clip", F.least("span_end", "text_end"))
        .filter(F.col("span_start") <= F.col("clip"))
    )
    hits = (
        clipped.withColumn("bin", bins("span_start", "clip"))
        .join(real.withColumn("bin", bins("start_pos", "end_pos")), ["doc_id", "bin"])
        .filter((F.col("span_start") < F.col("end_pos")) & (F.col("span_end") > F.col("start_pos")))
        .select("doc_id", "span_id", "page")
        .distinct()
    )
    missed = (
        spans.select("doc_id", "span_id")
        .join(hits.select("doc_id", "span_id").distinct(), ["doc_id", "span_id"], "left_anti")
        .join(extent.select("doc_id", "first_page"), "doc_id")
        .select("doc_id", "span_id", F.col("first_page").alias("page"))
    )
    return hits.unionByName(missed)


def part_blocks(lines: DataFrame) -> DataFrame:
    """Part blocks of a paper: heading line to the line before the next part.

    A heading that repeats the number and kind of the one before continues its block.
    """
    lines = lines.withColumn("line", F.regexp_replace("line", "\u00a0", " "))
    label = tx.fold_roman_signs(F.regexp_extract("line", _PART_HEADING, 1))
    rest = F.regexp_extract("line", _PART_HEADING, 2)
    # Headings are few, but several steps below read them.
    headings = (
        lines.filter(F.col("line").rlike(_PART_HEADING))
        .select(
            "paper_id", "line_no",
            tx.label_number(label).alias("part_number"),
            tx.clean_title(F.concat_ws(" ", F.lit("Part"), label, rest)).alias("title"),
            F.coalesce(F.regexp_extract(rest, r"(?i)(\d+)\s*minutes?", 1).try_cast("int"), F.lit(0)).alias("minutes"),
            F.coalesce(F.regexp_extract(rest, r"(?i)(\d+(?:\.\d+)?)\s*points?", 1).try_cast("double"), F.lit(0.0)).alias("points"),
        )
        .withColumn("signature", F.struct("part_number", tx.section_kind(F.col("title")).alias("kind")))
    )
    opened = running(
        headings, ["paper_id"], ["line_no"], _line_block(),
        {"previous": Running("last", F.col("signature"), inclusive=False)},
    ).filter(F.col("previous").isNull() | (F.col("previous") != F.col("signature")))
    closed = running(
        opened.drop("previous"), ["paper_id"], ["line_no"], _line_block(),
        {"next_start": Running("last", F.col("line_no"), inclusive=False)}, reverse=True,
    )
    last = lines.groupBy("paper_id").agg(F.max("line_no").alias("last_line"))
    return closed.join(last, "paper_id").select(
        "paper_id", "part_number", "title", "minutes", "points",
        F.col("line_no").alias("start_line"),
        F.coalesce(F.col("next_start") - 1, F.col("last_line")).alias("end_line"),
        F.col("signature.kind").alias("kind"),
    )


def part_metadata(lines: DataFrame) -> DataFrame:
    """Title, minutes, points and directions per part; the last heading of a part wins."""
    is_heading = F.col("line").rlike(_PART_META)
    held = (
        running(
            lines.select("paper_id", "line_no", "line"), ["paper_id"], ["line_no"], _line_block(),
            {"heading_line": Running("last", F.when(is_heading, F.col("line_no")))},
        ).filter(F.col("heading_line").isNotNull())
    )
    body = held.filter(F.col("line_no") > F.col("heading_line"))
    keys = ["paper_id", "heading_line"]
    opens = body.filter(F.col("line").rlike(r"(?i)Directions\s*:")).groupBy(*keys).agg(F.min("line_no").alias("opens"))
    after = body.join(opens, keys).filter(F.col("line_no") >= F.col("opens"))
    limits = after.groupBy(*keys).agg(
        F.min(F.when(F.col("line").rlike(r"(?i)centre\."), F.col("line_no"))).alias("centre"),
        F.min(
            F.when(
                (F.col("line_no") > F.col("opens")) & F.col("line").rlike(r"(?i)^\s*(?:Passage\s+\d+|\d+\s*[.、])(?:\s|$)"),
                F.col("line_no") - 1,
            )
        ).alias("boundary"),
    )
    # Only the lines of the directions themselves are gathered.
    picked = (
        after.join(limits, keys)
        .filter(F.col("line_no") <= F.coalesce("centre", "boundary", "line_no"))
        .groupBy(*keys, "centre")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("t"))
    )
    trimmed = F.regexp_replace("t", r"(?is)^.*?(?=Directions\s*:)", "")
    cut = F.when(F.col("centre").isNotNull(), F.regexp_extract(trimmed, r"(?is)^(.*?centre\.)", 1)).otherwise(trimmed)
    directions = picked.select(
        *keys, tx.strip(F.regexp_replace(tx.strip_page_artifacts(cut), r"\s+\n", "\n")).alias("directions")
    )
    label = F.regexp_extract("line", _PART_META, 1)
    minutes = F.regexp_extract("line", _PART_META, 3).try_cast("int")
    points = F.regexp_extract("line", _PART_META, 4).try_cast("double")
    shown = F.regexp_replace(points.cast("string"), r"\.0$", "")
    suffix = F.when(
        minutes.isNotNull() & points.isNotNull(),
        F.concat(F.lit("("), minutes.cast("string"), F.lit(" minutes, "), shown, F.lit(" points)")),
    )
    heads = held.filter(F.col("line_no") == F.col("heading_line")).select(
        *keys,
        tx.label_number(tx.fold_roman_signs(label)).alias("part_number"),
        tx.clean_title(F.concat_ws(" ", F.lit("Part"), label, tx.strip(F.regexp_extract("line", _PART_META, 2)), suffix)).alias("title"),
        minutes.alias("minutes"), points.alias("points"),
    )
    return (
        heads.join(directions, keys, "left")
        .groupBy("paper_id", "part_number")
        .agg(F.max_by(F.struct("title", "minutes", "points", F.coalesce("directions", F.lit("")).alias("directions")), "heading_line").alias("m"))
        .select("paper_id", "part_number", "m.*")
    )


def scope_lines(lines: DataFrame) -> DataFrame:
    """Current part of every line (``unscoped`` before the first heading); state crosses pages.

    Full-width text is folded first, so full-width headings and numbers count too.
    """
    rows = lines.withColumn("line", tx.nfkc(F.col("line")))
    label = F.regexp_extract("line", _SCOPE_HEADING, 1)
    heading = F.when(
        F.col("line").rlike(_SCOPE_HEADING),
        F.struct(
            F.concat(F.lit("part-"), F.upper(label)).alias("scope"),
            tx.section_kind(F.regexp_extract("line", _SCOPE_HEADING, 2)).alias("kind"),
        ),
    )
    carried = running(rows, ["paper_id"], ["line_no"], _line_block(), {"part": Running("last", heading)})
    return carried.select(
        *rows.columns,
        F.coalesce(F.col("part.scope"), F.lit("unscoped")).alias("scope"),
        F.col("part.kind").alias("scope_kind"),
    )


def split_directions(blocks: DataFrame) -> DataFrame:
    """Directions and body of every block text (other columns are kept)."""
    t = F.col("text")
    at = F.regexp_instr(t, F.lit(r"(?i)Directions\s*:"))
    tail = F.when(at > 0, F.substr(t, at))
    through_centre = F.regexp_extract("tail", r"(?is)^(.*?centre\.)", 1)
    boundary = F.regexp_instr(
        F.col("tail"),
        F.lit(r"(?im)^\s*(?:[A-D]\s+)?(?:Passage\s+(?:\d+|One|Two|Three|Four)\b|\d+\s*[.、])\s*"),
    )
    paragraph = F.regexp_instr(F.col("tail"), F.lit(r"\n\s*\n"))
    positive = lambda c: F.when(c > 0, c - 1)
    size = (
        F.when(through_centre != "", F.length(through_centre))
        .otherwise(F.coalesce(F.least(positive(boundary), positive(paragraph)), F.length("tail")))
    )
    rows = blocks.withColumn("at", at).withColumn("tail", tail).withColumn("size", size)
    kept = [c for c in blocks.columns if c != "text"]
    return rows.select(
        *kept,
        F.coalesce(tx.clean_paragraphs(F.substr(F.col("tail"), F.lit(1), F.col("size"))), F.lit("")).alias("directions"),
        F.when(F.col("at") > 0, F.substr(F.col("tail"), F.col("size") + 1)).otherwise(t).alias("body"),
    )


def numbered_blocks(
    lines: DataFrame, keys: list[str], min_number: int = 1, max_number: int = 999
) -> DataFrame:
    """Lines with the numbered item they belong to; lines before the first item are dropped.

    The result stays row-shaped: an item is the set of its lines, not one gathered text.
    """
    number = F.regexp_extract("line", _NUMBER_LINE, 1).try_cast("int")
    marker = F.when(number.between(min_number, max_number), F.struct(F.col("line_no").alias("start_line"), number.alias("number")))
    carried = running(lines.select(*keys, "line_no", "line"), keys, ["line_no"], _line_block(), {"item": Running("last", marker)})
    return carried.filter(F.col("item").isNotNull()).select(*keys, "item.start_line", "item.number", "line_no", "line")


def _item_texts(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Text of each numbered item after its number."""
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n"
    )
    return blocks.groupBy(*keys, "start_line", "number").agg(
        F.regexp_replace(joined, _NUMBER_HEAD, "").alias("remainder")
    )


def choice_options(blocks: DataFrame, keys: list[str], option_ids: str = "ABCD") -> DataFrame:
    """Stem and options of every numbered item; options as ``id=text`` pairs in order."""
    marker = rf"(?<![A-Za-z0-9])([{option_ids}])\s*[.、]\s+"
    ids = F.regexp_extract_all("remainder", F.lit(marker), F.lit(1))
    pieces = F.split("remainder", marker)
    texts = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), tx.clean_inline)
    pairs = F.zip_with(ids, texts, lambda i, t: F.concat(i, F.lit("="), t))
    return _item_texts(blocks, keys).select(
        *keys, "number",
        F.when(F.size(ids) > 0, "single_choice").otherwise("unknown").alias("type"),
        tx.clean_inline(F.get(pieces, F.lit(0))).alias("stem"),
        F.array_join(pairs, "|").alias("options"),
    )


def short_answers(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Numbered free-text questions; blank ones are dropped."""
    return (
        _item_texts(blocks, keys)
        .select(*keys, "number", F.lit("short_answer").alias("type"), tx.clean_inline(F.col("remainder")).alias("stem"))
        .filter(F.col("stem") != "")
    )


def passages(lines: DataFrame, part_points: DataFrame, default_points: float = 20.0) -> DataFrame:
    """Passages of the reading part with their text, question range and score per question.

    ``lines`` are the lines of the reading part only; ``part_points``: ``paper_id, points``.
    """
    word = F.lower(F.regexp_extract("line", _PASSAGE_LINE, 1))
    # Spelled passage labels.
    label = F.when(word == "one", "1").when(word == "two", "2").when(word == "three", "3").when(word == "four", "4").otherwise(word)
    rows = lines.select("paper_id", "line_no", "line")
    heads = rows.filter(F.col("line").rlike(_PASSAGE_LINE)).select("paper_id", "line_no", label.alias("label"))
    opened = running(
        heads, ["paper_id"], ["line_no"], _line_block(),
        {"previous": Running("last", F.col("label"), inclusive=False)},
    ).filter(F.col("previous").isNull() | (F.col("previous") != F.col("label"))).select(
        "paper_id", "line_no", F.struct(F.col("line_no").alias("start_line"), "label").alias("opening")
    )
    held = running(
        rows.join(opened, ["paper_id", "line_no"], "left"), ["paper_id"], ["line_no"], _line_block(),
        {"passage": Running("last", F.col("opening"))},
    ).filter(F.col("passage").isNotNull() & F.col("opening").isNull())
    keys = ["paper_id", "start_line", "label"]
    body = (
        held.select("paper_id", "passage.*", "line_no", "line").withColumn(
            "number", F.regexp_extract("line", _NUMBER_LINE, 1).try_cast("int")
        )
    )
    counted = body.groupBy(*keys).agg(
        F.count("number").alias("n_questions"),
        F.min("number").alias("first_number"),
        F.max("number").alias("last_number"),
        F.min(F.when(F.col("number").isNotNull(), F.col("line_no"))).alias("first_line"),
    ).filter(F.col("n_questions") > 0)
    texts = (
        body.join(counted.select(*keys, "first_line"), keys)
        .filter(F.col("line_no") < F.col("first_line"))
        .groupBy(*keys)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("t"))
    )
    totals = counted.groupBy("paper_id").agg(F.sum("n_questions").alias("paper_questions"))
    points = F.when(F.col("points") > 0, F.col("points")).otherwise(F.lit(default_points))
    return (
        counted.join(texts, keys, "left")
        .join(totals, "paper_id")
        .join(part_points.select("paper_id", "points"), "paper_id", "left")
        .select(
            "paper_id", F.col("label").alias("passage"),
            F.coalesce(tx.clean_paragraphs(F.col("t")), F.lit("")).alias("description"),
            "n_questions", "first_number", "last_number",
            ratio(points, F.col("paper_questions")).cast("double").alias("score"),
        )
    )


def _blank_pattern(text: Column, number: Column, guard: str) -> Column:
    n = number.cast("string")
    marked = F.concat(F.lit(r"_+\s*"), n, F.lit(r"\s*_+"))
    bare = F.concat(F.lit(rf"(?<![{guard}])"), n, F.lit(r"(?![A-Za-z0-9_])"))
    return F.when(F.regexp_like(text, marked), marked).otherwise(bare)


def _around_blank(rows: DataFrame, text: Column, guard: str) -> DataFrame:
    found = rows.withColumn("t", text).withColumn("pattern", _blank_pattern(F.col("t"), F.col("number"), guard))
    found = found.withColumn("at", F.regexp_instr("t", F.col("pattern"))).withColumn(
        "blank", F.regexp_substr("t", F.col("pattern"))
    )
    return found.withColumn("before", F.substr("t", F.lit(1), F.col("at") - 1)).withColumn(
        "after", F.substr("t", F.col("at") + F.length("blank"))
    )


def cloze_contexts(questions: DataFrame, texts: DataFrame, low: int = 21, high: int = 40) -> DataFrame:
    """Sentence around each blank; a long one becomes a window with ellipses.

    ``questions``: ``doc_id, number``; ``texts``: ``doc_id, text``.
    """
    rows = _around_blank(questions.join(texts, "doc_id"), tx.clean_inline(F.col("text")), "A-Za-z0-9_$")
    # Cleaning is long; without a table between, every expression below would hold a copy of it.
    rows = staged(rows.filter(F.col("at") > 0).select("doc_id", "number", "t", "at", "blank"), "blanks")
    rows = rows.withColumns({"before": F.substr("t", F.lit(1), F.col("at") - 1), "after": F.substr("t", F.col("at") + F.length("blank"))})
    closing = r"""["”’')\]]?"""
    left = F.regexp_replace("before", rf"(?s)^.*{_SENTENCE_MARKS}{closing}\s+", "")
    to_stop = F.regexp_extract("after", rf"(?s)^(.*?{_SENTENCE_MARKS}{closing})(?=\s|$)", 1)
    right = F.when(to_stop != "", to_stop).otherwise(F.col("after"))
    sentence = tx.strip(F.concat(left, F.col("blank"), right))
    start, end = F.col("at") - 1, F.col("at") - 1 + F.length("blank")
    lo = F.greatest(F.lit(0), start - 140)
    hi = F.least(F.length("t"), end + 180)
    window = F.concat(
        F.when(lo > 0, "...").otherwise(""),
        tx.strip(F.substr("t", lo + 1, hi - lo)),
        F.when(hi < F.length("t"), "...").otherwise(""),
    )
    numbers = "|".join(str(n) for n in range(low, high + 1))
    marked = F.regexp_replace(F.when(F.length(sentence) <= 360, sentence).otherwise(window), rf"_+\s*({numbers})\s*_+", "__$1__")
    marked = F.regexp_replace(marked, rf"(?<![A-Za-z0-9_$])({numbers})(?![A-Za-z0-9_])", "__$1__")
    return rows.select("doc_id", "number", tx.squeeze(marked).alias("context")).filter(F.col("context") != "")


def cloze_sentence(cloze: DataFrame) -> DataFrame:
    """Sentence between the nearest sentence marks around the blank; empty when there is none."""
    rows = _around_blank(cloze, tx.squeeze(F.col("text")), "A-Za-z0-9_")
    left = F.regexp_replace("before", rf"(?s)^.*{_SENTENCE_MARKS}", "")
    to_mark = F.regexp_extract("after", rf"(?s)^(.*?{_SENTENCE_MARKS})", 1)
    right = F.when(to_mark != "", to_mark).otherwise(F.col("after"))
    sentence = F.when(F.col("at") > 0, tx.strip(F.concat(left, F.col("blank"), right))).otherwise("")
    return rows.select("doc_id", "number", sentence.alias("sentence"))


def repair_cloze(merged: DataFrame, sections: DataFrame, page_texts: DataFrame) -> DataFrame:
    """All cloze questions 21–40 of a paper in its first cloze section, with the passage.

    ``merged``: merged questions with ``section_title``; ``sections``: ``paper_id, section_no,
    section_title, description``; ``page_texts``: ``paper_id, description`` read from pages.
    """
    cloze = sections.filter(tx.is_cloze_title(F.col("section_title")))
    target = cloze.groupBy("paper_id").agg(
        F.min("section_no").alias("section_no"),
        F.max_by(F.coalesce("description", F.lit("")), F.struct(F.length(F.coalesce("description", F.lit(""))), -F.col("section_no"))).alias("own"),
    )
    description = F.coalesce(tx.blank_to_null(F.col("page_description")), F.col("own"))
    kept = merged.filter(F.col("number").cast("string").rlike(r"^\d+$") & F.col("number").between(21, 40))
    return (
        kept.join(target, "paper_id")
        .join(page_texts.select("paper_id", F.col("description").alias("page_description")), "paper_id", "left")
        .select(
            "paper_id", "section_no", "number",
            F.when(tx.strip(F.col("stem")) == "", F.concat(F.lit("Blank "), F.col("number").cast("string")))
            .otherwise(F.col("stem")).alias("stem"),
            "answer", description.alias("description"),
        )
    )


def repair_reading(sections: DataFrame, passage_rows: DataFrame) -> DataFrame:
    """Replace all reading sections of a paper by one built from its passages.

    ``sections``: ``paper_id, section_no, section_title, total_score, score, n_questions``.
    Papers without passages or without a reading section stay as they are.
    """
    reading = tx.is_reading_title(F.col("section_title"))
    base = sections.filter(reading).groupBy("paper_id").agg(
        F.min_by(F.struct("section_no", "section_title", "total_score"), "section_no").alias("b")
    )
    built = passage_rows.groupBy("paper_id").agg(F.sum("n_questions").alias("n")).join(base, "paper_id")
    total = F.when(F.col("b.total_score") > 0, F.col("b.total_score").cast("double")).otherwise(F.lit(20.0))
    title = F.regexp_replace(tx.clean_title(F.col("b.section_title")), r"(?i)\s+-\s+Passage\s+\d+\s*$", "")
    repaired = built.select(
        "paper_id", F.col("b.section_no").alias("section_no"),
        F.when(title == "", "Part III Reading Comprehension").otherwise(title).alias("section_title"),
        total.alias("total_score"), ratio(total, F.col("n")).cast("double").alias("score"),
        F.col("n").alias("n_questions"),
    )
    columns = ["paper_id", "section_no", "section_title", "total_score", "score", "n_questions"]
    typed = sections.select(
        "paper_id", "section_no", "section_title", F.col("total_score").cast("double").alias("total_score"),
        F.col("score").cast("double").alias("score"), "n_questions",
    )
    replaced = built.select("paper_id").withColumn("drop", F.lit(True))
    kept = typed.join(replaced, "paper_id", "left").filter(F.col("drop").isNull() | ~reading)
    return kept.select(*columns).unionByName(repaired.select(*columns))


def without_directions(text: Column) -> Column:
    """Description without its leading directions."""
    raw = tx.strip(text)
    centre = F.regexp_extract(raw, r"(?is)^(.*?centre\.)", 1)
    after = F.when(centre != "", F.substr(raw, F.length(centre) + 1)).otherwise(
        F.coalesce(F.get(F.split(raw, r"\n\s*\n", 2), F.lit(1)), F.lit(""))
    )
    return F.when(raw.rlike(r"(?i)^Directions\s*:"), tx.strip(after)).otherwise(raw)


def repair_parts(sections: DataFrame, meta: DataFrame) -> DataFrame:
    """Titles and directions from the printed part headings.

    ``sections``: ``paper_id, section_no, section_title, description``.
    """
    m = meta.select("paper_id", "part_number", F.col("title").alias("m_title"), F.col("directions").alias("m_directions"))
    rows = sections.withColumn("part_number", tx.part_number(F.col("section_title"))).join(m, ["paper_id", "part_number"], "left")
    title = F.when(
        (F.coalesce("m_title", F.lit("")) != "") & ~tx.is_reading_title(F.col("section_title")), F.col("m_title")
    ).otherwise(F.col("section_title"))
    own = tx.strip(F.coalesce("description", F.lit("")))
    passage = tx.is_reading_title(F.col("new_title")) | tx.is_cloze_title(F.col("new_title"))
    given = F.coalesce("m_directions", F.lit(""))
    description = (
        F.when(given == "", F.col("description"))
        .when(passage, tx.join_parts(given, without_directions(own)))
        .when((own == "") | (F.length(given) > F.length(own)), given)
        .otherwise(F.col("description"))
    )
    return rows.withColumn("new_title", title).select(
        "paper_id", "section_no", F.col("new_title").alias("section_title"), description.alias("description")
    )


def writing_question(lines: DataFrame, previous_numbers: DataFrame, default: int = 53) -> DataFrame:
    """One essay per writing block.

    ``lines``: lines of the writing part without its heading; ``previous_numbers``:
    ``paper_id, number`` of the questions found so far. A ``1.`` after an outline marker is a
    bullet, and then the essay gets the next free number.
    """
    numbered = F.regexp_extract("line", r"^\s*(\d+)\s*[.、](?:\s|$)", 1)
    first = lines.filter(numbered != "").groupBy("paper_id").agg(
        F.min_by(F.struct("line_no", numbered.alias("number")), "line_no").alias("mark")
    )
    outline = lines.filter(F.col("line").rlike(r"(?i)\boutline\b|提纲|要点")).groupBy("paper_id").agg(
        F.min("line_no").alias("outline_line")
    )
    used = previous_numbers.filter(F.col("number").cast("string").rlike(r"^\d+$")).groupBy("paper_id").agg(
        F.max(F.col("number").try_cast("int")).alias("last_number")
    )
    text = lines.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("rows"))
    bullet = (F.col("mark.number") == "1") & (F.col("outline_line") < F.col("mark.line_no"))
    rows = (
        text.join(first, "paper_id", "left").join(outline, "paper_id", "left").join(used, "paper_id", "left")
        .withColumn("mark", F.when(~F.coalesce(bullet, F.lit(False)), F.col("mark")))
    )
    body = F.transform(
        F.col("rows"),
        lambda s: F.when(s["line_no"] == F.col("mark.line_no"), F.regexp_replace(s["line"], r"^\s*\d+\s*[.、]\s*", "")).otherwise(s["line"]),
    )
    return rows.select(
        "paper_id",
        F.coalesce(F.col("mark.number"), (F.coalesce("last_number", F.lit(default)) + 1).cast("string")).alias("number"),
        tx.clean_lines(F.array_join(body, "\n")).alias("stem"),
    )


def build_standard(lines: DataFrame) -> DataFrame:
    """Sections of every paper in the five-part layout (at least 50 questions)."""
    # Part number, kind and default points of the standard layout.
    layout = {"1": ("choice", 30.0), "2": ("cloze", 20.0), "3": ("reading", 20.0), "4": ("translation", 15.0), "5": ("writing", 15.0)}
    blocks = part_blocks(lines)
    shape = blocks.groupBy("paper_id").agg(
        *[F.max_by(F.when(F.col("part_number") == p, F.col("kind")), F.when(F.col("part_number") == p, F.col("start_line"))).alias(f"k{p}") for p in layout],
        F.sum("minutes").alias("minutes"),
    )
    for p, (kind, _) in layout.items():
        shape = shape.filter(F.col(f"k{p}") == kind)
    shape = shape.select("paper_id", F.when(F.col("minutes") > 0, F.col("minutes")).otherwise(120).alias("duration_minutes"))
    held = running(
        lines.select("paper_id", "line_no", "line").join(
            blocks.select("paper_id", F.col("start_line").alias("line_no"), F.struct("start_line", "part_number").alias("opening")),
            ["paper_id", "line_no"], "left",
        ),
        ["paper_id"], ["line_no"], _line_block(), {"part": Running("last", F.col("opening"))},
    ).filter(F.col("opening").isNull() & F.col("part").isNotNull()).select("paper_id", "part.*", "line_no", "line")
    number = F.regexp_extract("line", _NUMBER_LINE, 1).try_cast("int")
    counted = held.withColumn("number", number).filter(F.col("number").isNotNull())
    kept = counted.filter(
        F.when(F.col("part_number") == "1", F.col("number").between(1, 20))
        .when(F.col("part_number") == "2", F.col("number").between(21, 40))
        .otherwise(F.col("part_number").isin("3", "4"))
    )
    in_passages = passages(held.filter(F.col("part_number") == "3"), blocks.filter(F.col("part_number") == "3").select("paper_id", "points"))
    per_part = (
        kept.filter(F.col("part_number") != "3").groupBy("paper_id", "part_number").agg(F.count("*").alias("n"))
        .unionByName(in_passages.groupBy("paper_id").agg(F.sum("n_questions").alias("n")).withColumn("part_number", F.lit("3")))
        .unionByName(blocks.filter(F.col("part_number") == "5").select("paper_id", "part_number", F.lit(1).cast("bigint").alias("n")))
    )
    enough = per_part.groupBy("paper_id").agg(F.sum("n").alias("paper_questions")).filter(F.col("paper_questions") >= 50)
    default = F.create_map(*[x for p, (_, d) in layout.items() for x in (F.lit(p), F.lit(d))])
    points = F.when(F.col("points") > 0, F.col("points")).otherwise(F.element_at(default, F.col("part_number")))
    fixed = F.create_map(*[x for p, s in {"1": 1.5, "2": 1.0, "4": 3.0, "5": 15.0}.items() for x in (F.lit(p), F.lit(s))])
    return (
        blocks.join(shape, "paper_id").join(enough, "paper_id").join(per_part, ["paper_id", "part_number"])
        .select(
            "paper_id", "part_number", "title", "duration_minutes", points.alias("total_score"),
            F.coalesce(F.try_element_at(fixed, F.col("part_number")), ratio(points, F.col("n")).cast("double")).alias("score"),
            F.col("n").alias("n_questions"),
        )
    )


def exam_words(questions: DataFrame, passage_texts: DataFrame) -> DataFrame:
    """Distinct stems, option texts and passage texts.

    ``questions``: ``stem, options array<string>``; ``passage_texts``: ``description``.
    """
    return (
        questions.select(F.coalesce("stem", F.lit("")).alias("word"))
        .union(questions.select(F.explode("options")))
        .union(passage_texts.select(F.coalesce("description", F.lit(""))))
        .distinct()
    )
