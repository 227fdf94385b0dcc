"""Complete papers in the 57-item layout, from recognised lines.

Lines are rows ``paper_id, page, line_no, line``. What a line belongs to is carried by one block
scan, checks of numbers are counts, and texts are gathered only for papers whose counts are right,
so that a long text without the layout never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.scans import Running, running
from ..functions.staging import staged
from .pages import _line_block

# Patterns of names, headings and markers, and what must stand in the headings.
NAME = r"(?i)四级|CET[- ]?4"
FURNITURE = r"小红书|20\d{2}.*四级.*(?:真题|考试)"
PARTS = {"I": "writing", "II": "listening", "III": "reading", "IV": "translation"}
_PART = r"(?iU)^\s*Part\s+([IVX]+)(?:\s+(\S.*))?$"
_SECTION = r"(?iU)^\s*Section\s+([ABC])\s*$"
_PASSAGE = r"(?iU)^\s*Passage\s+(One|Two)\s*$"
_ITEM = r"(?U)^\s*(\d{1,2})\s*[.、]\s*"
_STATEMENT = r"(?U)^\s*(\d{2})\.\s*"
_STOP = r"(?iU)^\s*(?:Section\s+[A-C]\b|Directions\s*:|Questions\s+\d+\b)"
_BANK = r"(?U)^\s*A\)\s*"
_CHOICE = r"(?U)(?<!\w)([A-D])\s*[).、]\s*"
_BANK_WORD = r"(?U)\b([A-O])\)\s*"
_LETTER = r"(?mU)^\s*([A-Z])\)\s+"
AUDIO_STEM = "本题的问题在听力音频中，PDF 仅提供选项。请播放原卷配套音频后作答。"
AUDIO_NOTE = "请结合原卷听力音频作答。本 PDF 未提供音频。"

# Kind, title and points of the sections.
SECTIONS = [
    ("writing", "作文", 15), ("listening", "听力（第 1—15 题）", 15), ("listening", "听力（第 16—25 题）", 20),
    ("wordbank", "选词填空", 5), ("matching", "阅读匹配", 10), ("reading", "阅读", 20), ("translation", "汉译英", 15),
]
MINUTES, POINTS = 125, 100


def _shape(held: DataFrame) -> DataFrame:
    """Where the last part or section of a label begins, for papers that have them all by name."""
    part, section = F.col("part.label"), F.col("section.label")
    is_part, is_section = F.col("line_no") == F.col("part.line_no"), F.col("line_no") == F.col("section.line_no")
    named = F.when(F.col("named") != "", F.col("line_no"))
    found = held.groupBy("paper_id").agg(
        F.bool_and(part.isNull() | part.isin(*PARTS)).alias("known"),
        *[F.max(F.when(part == p, F.col("part.line_no"))).alias(f"part_{p}") for p in PARTS],
        *[F.min_by("named", F.when(part == p, named)).alias(f"name_{p}") for p in PARTS],
        *[F.max(F.when((part == "III") & is_section & (section == s), F.struct("part.line_no", F.col("line_no").alias("at")))).alias(f"section_{s}") for s in "ABC"],
        F.max(F.when((part == "III") & is_section & ~section.isin(*"ABC"), F.col("part.line_no"))).alias("odd_section"),
        F.max(F.when(is_part, F.col("line_no"))).alias("last_part"),
        F.min_by("page", "line_no").alias("first_page"), F.max_by("page", "line_no").alias("last_page"),
    )
    good = F.col("known")
    for p, word in PARTS.items():
        good = good & F.contains(F.lower(f"name_{p}"), F.lit(word))
    for s in "ABC":
        good = good & (F.col(f"section_{s}.line_no") == F.col("part_III"))
    good = good & F.coalesce(F.col("odd_section") != F.col("part_III"), F.lit(True))
    return found.filter(good).select(
        "paper_id", "first_page", "last_page", *[f"part_{p}" for p in PARTS], *[F.col(f"section_{s}.at").alias(f"section_{s}") for s in "ABC"]
    )


def _slots(held: DataFrame, shape: DataFrame) -> DataFrame:
    """Lines with the text or item they belong to: ``section_no, group_no, role, number, start_line``."""
    rows = held.join(shape, "paper_id")

    def inside(label: str) -> Column:
        return (F.col("part.line_no") == F.col(f"part_{label}")) & (F.col("line_no") > F.col("part.line_no")) & ~F.col("is_name")

    def within(label: str) -> Column:
        return inside("III") & (F.col("section.line_no") == F.col(f"section_{label}")) & (F.col("line_no") > F.col("section.line_no"))

    def slot(section: Column | int, group: Column | int, role: str, number: Column | None = None, start: Column | None = None) -> Column:
        return F.struct(
            F.lit(section).alias("section_no") if isinstance(section, int) else section.alias("section_no"),
            F.lit(group).alias("group_no") if isinstance(group, int) else group.alias("group_no"),
            F.lit(role).alias("role"),
            (F.lit(None).cast("int") if number is None else number).alias("number"),
            (F.lit(None).cast("bigint") if start is None else start).alias("start_line"),
        )

    def running_item(after: str) -> Column:
        return (F.col("item.line_no") > F.col(after)) & F.coalesce(F.col("stop") < F.col("item.line_no"), F.lit(True))

    number, start = F.col("item.number"), F.col("item.line_no")
    group = F.when(F.col("passage.label") == "one", 1).otherwise(2)
    in_passage = within("C") & (F.col("passage.line_no") > F.col("section.line_no")) & (F.col("line_no") > F.col("passage.line_no"))
    stated = F.col("statement.line_no") > F.col("section.line_no")
    text = (
        F.when(inside("I"), slot(0, 0, "text")).when(inside("IV"), slot(6, 0, "text"))
        .when(within("A"), F.when(F.col("bank") > F.col("section.line_no"), slot(3, 0, "bank")).otherwise(slot(3, 0, "text")))
        .when(within("B"), F.when(stated, slot(4, 0, "item", F.col("statement.number"), F.col("statement.line_no"))).otherwise(slot(4, 0, "text")))
        .when(in_passage & ~F.coalesce(F.col("statement.line_no") > F.col("passage.line_no"), F.lit(False)), slot(5, group, "text"))
    )
    item = F.when(
        inside("II") & running_item("part.line_no") & number.between(1, 25),
        slot(F.when(number <= 15, 1).otherwise(2), 0, "item", number, start),
    ).when(
        in_passage & running_item("passage.line_no") & number.between(41 + group * 5, 45 + group * 5), slot(5, group, "item", number, start)
    )
    opens = F.when(within("C") & (F.col("line_no") == F.col("passage.line_no")), F.col("passage.label"))
    return rows.select(
        "paper_id", "line_no", "line", F.col("line_no").eqNullSafe(F.col("bank")).alias("opens_bank"), opens.alias("opens_passage"),
        F.explode_outer(F.filter(F.array(text, item), lambda s: s.isNotNull())).alias("slot"),
    ).select("paper_id", "line_no", "line", "opens_bank", "opens_passage", "slot.*")


def _counted(slots: DataFrame) -> DataFrame:
    """Papers whose markers have the right counts; what is gathered later is bounded by them."""
    begins = (F.col("role") == "item") & (F.col("line_no") == F.col("start_line"))
    first = F.min(F.when(F.col("opens_passage") == "one", F.col("line_no")))
    second = F.min(F.when(F.col("opens_passage") == "two", F.col("line_no")))
    wanted = {"listening": (F.col("section_no").isin(1, 2), 25), "statements": (F.col("section_no") == 4, 10), "one": ((F.col("section_no") == 5) & (F.col("group_no") == 1), 5), "two": ((F.col("section_no") == 5) & (F.col("group_no") == 2), 5)}
    counts = slots.groupBy("paper_id").agg(
        *[F.count_if(begins & which).alias(name) for name, (which, _) in wanted.items()],
        F.count_if(F.col("opens_bank") & (F.col("role") == "bank")).alias("banks"),
        F.count("opens_passage").alias("passages"), (first < second).alias("in_order"),
    )
    good = (F.col("banks") == 1) & (F.col("passages") == 2) & F.col("in_order")
    for name, (_, n) in wanted.items():
        good = good & (F.col(name) == n)
    return counts.filter(good).select("paper_id")


def _pieces(text: Column, marker: str) -> tuple[Column, Column]:
    """Ids that markers give and the texts after them; the first text stands before all markers."""
    return F.regexp_extract_all(text, F.lit(marker), F.lit(1)), F.split(text, marker)


def _options(ids: Column, texts: Column) -> Column:
    pairs = F.zip_with(ids, F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0))), lambda i, t: F.struct(i.alias("id"), t.alias("text")))
    return F.array_sort(pairs)


def _source_pages(rows: DataFrame) -> DataFrame:
    """Pages on which a number stands before a dot or between underscores."""
    marks = F.concat(
        F.regexp_extract_all("line", F.lit(r"(?U)^\s*(\d+)\.(?:\s|$)"), F.lit(1)), F.regexp_extract_all("line", F.lit(r"(?U)_\s*(\d+)\s*(?=_)"), F.lit(1))
    )
    found = rows.select("paper_id", "page", F.explode(F.array_distinct(marks)).alias("number")).filter(F.col("number").rlike("^([1-9]|[1-4][0-9]|5[0-5])$"))
    return found.distinct().groupBy("paper_id", "number").agg(F.array_sort(F.collect_list("page")).alias("source_pages"))


def build_cet4(papers: DataFrame, lines: DataFrame, furniture: str = FURNITURE) -> DataFrame:
    """Questions of all papers that have the whole layout; other papers give no rows.

    ``papers``: ``paper_id, original_name, title`` (a null or empty title gives the name without its
    ending); ``lines``: ``paper_id, page, line_no, line``. A paper must be named as one of this exam
    and hold parts I to IV by name, listening items 1–25 and reading items 46–50 and 51–55 with
    options A–D, a bank of words A–O with blanks 26–35, and statements 36–45 after lettered
    paragraphs. Full-width text is folded; lines that ``furniture`` matches are dropped. Of repeated
    headings the last begins the text and the first names it. Null lines count as empty.

    Columns: ``paper_id, title, section_no, kind, section_title, total_score, group_title, number,
    type, stem, options array<struct<id,text>>, score, description, source_pages``.
    """
    meant = papers.filter(F.col("original_name").rlike(NAME)).select(
        "paper_id", F.coalesce(tx.blank_to_null(F.col("title")), F.regexp_replace("original_name", r"(?s)\.[^.]*$", "")).alias("title")
    )
    read = lines.select("paper_id", "page", "line_no", F.coalesce("line", F.lit("")).alias("line")).join(meant.select("paper_id"), "paper_id", "left_semi")
    rows = read.withColumn("line", tx.nfkc(F.col("line"))).filter(~F.col("line").rlike(furniture))
    line, at = F.col("line"), F.col("line_no")
    is_part, blank = line.rlike(_PART), tx.strip(line) == ""
    rest = F.regexp_extract("line", _PART, 2)

    def mark(pattern: str, **fields: Column) -> Column:
        return F.when(line.rlike(pattern), F.struct(at.alias("line_no"), *[c.alias(n) for n, c in fields.items()]))

    def extract(pattern: str) -> Column:
        return F.regexp_extract("line", pattern, 1)

    held = running(
        rows, ["paper_id"], ["line_no"], _line_block(),
        {
            "part": Running("last", mark(_PART, label=extract(_PART))),
            "section": Running("last", mark(_SECTION, label=extract(_SECTION))),
            "passage": Running("last", mark(_PASSAGE, label=F.lower(extract(_PASSAGE)))),
            "item": Running("last", mark(_ITEM, number=extract(_ITEM).cast("int"))),
            "statement": Running("last", mark(_STATEMENT, number=extract(_STATEMENT).cast("int"))),
            "stop": Running("last", F.when(line.rlike(_STOP), at)),
            "bank": Running("last", F.when(line.rlike(_BANK), at)),
            "after_bare": Running("last", F.when(~blank, is_part & (rest == "")), inclusive=False),
            "previous_page": Running("last", F.col("page"), inclusive=False),
        },
    )
    # The name of a part may stand on the line after its label.
    is_name = F.coalesce(F.col("after_bare"), F.lit(False)) & ~blank & ~is_part
    held = held.withColumn("is_name", is_name).withColumn("named", F.when(is_part, rest).when(is_name, line))
    # A page begins after an empty line.
    held = staged(held.withColumn("line", F.when(F.col("previous_page") != F.col("page"), F.concat(F.lit("\n"), line)).otherwise(line)), "layout")

    shape = staged(_shape(held), "layout")
    slots = staged(_slots(held, shape), "layout")
    kept = slots.join(_counted(slots), "paper_id", "left_semi").filter(F.col("role").isNotNull())
    gathered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")
    keys = ["paper_id", "section_no", "group_no", "role", "number", "start_line"]
    texts = staged(kept.groupBy(*keys).agg(gathered.alias("text")), "layout")

    section, role, text = F.col("section_no"), F.col("role"), F.col("text")
    head = F.when(section == 4, F.regexp_replace(text, _STATEMENT, "")).otherwise(F.regexp_replace(text, _ITEM, ""))
    ids, parts = _pieces(F.col("body"), _CHOICE)
    items = texts.filter(role == "item").withColumn("body", head)
    listening = section.isin(1, 2)
    items = items.select(
        *keys,
        F.when(listening, F.lit(AUDIO_STEM)).when(section == 5, tx.strip(F.get(parts, F.lit(0)))).otherwise(tx.strip(F.col("body"))).alias("stem"),
        F.when(section != 4, _options(ids, F.transform(parts, tx.squeeze))).alias("options"),
        F.when(section == 1, 1.0).when(section == 4, 1.0).otherwise(2.0).alias("score"),
    )
    word_ids, words = _pieces(F.concat_ws("", F.max(F.when(role == "bank", text))), _BANK_WORD)
    letters = F.regexp_extract_all(F.concat_ws("", F.max(F.when((section == 4) & (role == "text"), text))), F.lit(_LETTER), F.lit(1))
    passage = F.concat_ws("", F.max(F.when((section == 3) & (role == "text"), text)))
    blanks = F.lit(True)
    for n in range(26, 36):
        blanks = blanks & passage.rlike(rf"(?U)_+\s*{n}\s*_+")
    papers_ok = texts.filter(role != "item").groupBy("paper_id").agg(
        _options(word_ids, F.transform(words, tx.strip)).alias("words"), letters.alias("letters"), blanks.alias("blanks"),
    ).filter(
        F.col("blanks") & (F.size("letters") > 0) & (F.size(F.array_distinct("letters")) == F.size("letters"))
        & (F.transform("words", lambda o: o["id"]) == F.array(*[F.lit(c) for c in "ABCDEFGHIJKLMNO"]))
    )
    # The counts are right, so numbers in order of lines are one sequence each or the paper is dropped.
    four = F.array(*[F.lit(c) for c in "ABCD"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start_line", "number"))), lambda s: s["number"])
    sequences = items.withColumn("list", F.when(listening, 1).otherwise(section * 10 + F.col("group_no"))).groupBy("paper_id", "list").agg(
        ordered.alias("numbers"), F.bool_and((section == 4) | (F.transform("options", lambda o: o["id"]) == four)).alias("choices"),
    )
    first = F.when(F.col("list") == 1, 1).when(F.col("list") == 40, 36).when(F.col("list") == 51, 46).otherwise(51)
    straight = sequences.filter(F.col("choices") & (F.col("numbers") == F.sequence(first, first + F.size("numbers") - 1)))
    in_order = straight.groupBy("paper_id").count().filter("count = 4").select("paper_id")

    good = meant.join(papers_ok.drop("blanks"), "paper_id").join(in_order, "paper_id").join(shape.select("paper_id", "first_page", "last_page"), "paper_id")
    described = texts.filter(role == "text").select("paper_id", "section_no", "group_no", tx.strip(text).alias("own"))
    no_options = F.lit(None).cast("array<struct<id:string,text:string>>")
    blanks_rows = good.select(
        "paper_id", F.lit(3).alias("section_no"), F.lit(0).alias("group_no"), F.explode(F.sequence(F.lit(26), F.lit(35))).alias("number"),
    ).select("paper_id", "section_no", "group_no", F.col("number").cast("string").alias("number"), F.concat(F.lit("第 "), F.col("number").cast("string"), F.lit(" 空")).alias("stem"), no_options.alias("options"), F.lit(0.5).alias("score"))
    essays = good.select("paper_id", F.explode(F.array(F.lit(0), F.lit(6))).alias("section_no")).select(
        "paper_id", "section_no", F.lit(0).alias("group_no"), F.when(section == 0, "作文").otherwise("翻译").alias("number"),
        F.lit(None).cast("string").alias("stem"), no_options.alias("options"), F.lit(15.0).alias("score"),
    )
    numbered = items.select("paper_id", "section_no", "group_no", F.col("number").cast("string").alias("number"), "stem", "options", "score")
    every = numbered.unionByName(blanks_rows).unionByName(essays).join(good, "paper_id").join(described, ["paper_id", "section_no", "group_no"], "left")

    def of(index: int) -> Column:
        return F.element_at(F.array(*[F.lit(s[index]) for s in SECTIONS]), section + 1)

    free, own = section.isin(0, 6), F.coalesce("own", F.lit(""))
    matched = F.transform("letters", lambda c: F.struct(c.alias("id"), F.concat(F.lit("对应 "), c, F.lit(" 段")).alias("text")))
    pages = _source_pages(held.join(good.select("paper_id"), "paper_id", "left_semi").select("paper_id", "page", F.regexp_replace("line", r"^\n", "").alias("line")))
    end = F.when(section == 0, F.col("first_page")).otherwise(F.col("last_page"))
    return every.join(pages, ["paper_id", "number"], "left").select(
        "paper_id", "title", "section_no", of(0).alias("kind"), of(1).alias("section_title"), of(2).cast("double").alias("total_score"),
        F.when(section == 5, F.when(F.col("group_no") == 1, "Passage One").otherwise("Passage Two")).alias("group_title"),
        "number", F.when(section == 0, "essay").when(section == 6, "short_answer").otherwise("single_choice").alias("type"),
        F.when(free, own).otherwise(F.col("stem")).alias("stem"),
        F.when(section == 3, F.col("words")).when(section == 4, matched).when(free, F.array().cast("array<struct<id:string,text:string>>")).otherwise(F.col("options")).alias("options"),
        "score", F.when(listening, F.lit(AUDIO_NOTE)).when(free, F.lit("")).otherwise(own).alias("description"),
        F.when(free, F.array(end)).otherwise(F.coalesce("source_pages", F.array().cast("array<bigint>"))).alias("source_pages"),
    )
