"""Text rules as column expressions: all of them stay inside whole-stage codegen."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

# Section kinds in the order they are tried, and their title patterns.
KIND_PATTERNS = [
    ("listening", "listening|听力"),
    ("wordbank", "word.?bank|选词"),
    ("matching", "matching|匹配"),
    ("cloze", "cloze|完[型形]"),
    ("reading", "reading|阅读"),
    ("translation", "translation|翻译|汉译英"),
    ("writing", "writing|composition|essay|作文|写作"),
    ("choice", "vocabulary|structure|grammar|choice|词汇|语法|选择"),
]

# Single-character Roman numerals and their letter form.
ROMAN_SIGNS = {"Ⅰ": "I", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅴ": "V", "Ⅵ": "VI"}

# Lines that are page furniture, not exam text.
FURNITURE_LINES = [
    r"^[—-]\s*\d+\s*[—-]$",
    r"^\d+\s*/\s*\d+$",
    r"^_{3,}$",
    r"[|｜]\s*试题卷\s*$",
    r"(?i)^Part\s+[IVX\d]+\s+.*(?:continued|Choices for Questions)",
    r"(?i)^Passage\s+(?:\d+|One|Two|Three|Four)\s*[—–-]\s*Questions",
    r"海浪教育内部资料|绝密",
]


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """White space runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def compact(text: Column) -> Column:
    """Text without white space, lower case, for comparing stems."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def blank_to_null(text: Column) -> Column:
    return F.when(strip(text) != "", text)


def safe_id(value: Column) -> Column:
    kept = F.regexp_replace(F.coalesce(value, F.lit("")), "[^a-zA-Z0-9_-]", "")
    return F.when(kept == "", F.lit("unknown")).otherwise(kept)


def fold_roman_signs(text: Column) -> Column:
    for sign, letters in ROMAN_SIGNS.items():
        text = F.replace(text, F.lit(sign), F.lit(letters))
    return text


def clean_title(title: Column) -> Column:
    cleaned = squeeze(fold_roman_signs(F.coalesce(title, F.lit(""))))
    return F.when(cleaned == "", F.lit("题目")).otherwise(cleaned)


def section_kind(title: Column) -> Column:
    lowered = F.lower(F.coalesce(title, F.lit("")))
    rule = None
    for kind, pattern in KIND_PATTERNS:
        hit = lowered.rlike(pattern)
        rule = F.when(hit, F.lit(kind)) if rule is None else rule.when(hit, F.lit(kind))
    return rule.otherwise(F.lit("other"))


def nfkc(text: Column) -> Column:
    """Compatibility form of a text.

    Spark has no built-in for it, so this is an Arrow-batched function. ASCII texts are their own
    form: they go to it as nulls and stay JVM-side.
    """

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return F.coalesce(form(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def section_key(title: Column, type_: Column | None = None) -> Column:
    """``part-<label>`` for a part heading, else type or kind, else the folded title.

    ``title`` is taken as compatibility-normalised; wrap it in :func:`nfkc` when it can
    hold full-width characters.
    """
    label = F.upper(F.regexp_extract(title, r"(?i)\bPart\s+([IVX]+|\d+)\b", 1))
    kind = section_kind(title)
    named = F.coalesce(F.when(type_ != "", type_), kind) if type_ is not None else kind
    return (
        F.when(label != "", F.concat(F.lit("part-"), label))
        .when(kind != "other", named)
        .otherwise(strip(F.lower(title)))
    )


def canonical_section_key(title: Column) -> Column:
    cleaned = F.regexp_replace(clean_title(title), r"(?i)^part\s+", "part ")
    limits = r"(?i)[（(][^()（）]*(?:minutes?|points?|分钟|分)[^()（）]*[）)]"
    return F.lower(strip(F.regexp_replace(cleaned, limits, "")))


def roman_value(label: Column) -> Column:
    """Value of a label made of I, V, X: letters summed, smaller-before-larger taken off twice."""

    def times(pattern: str) -> Column:
        return F.regexp_count(label, F.lit(pattern))

    total = times("I") + times("V") * 5 + times("X") * 10
    return total - times("I(?=[VX])") * 2 - times("V(?=X)") * 10


def label_number(label: Column) -> Column:
    upper = F.upper(strip(label))
    value = roman_value(upper)
    return F.when(upper.rlike(r"^\d+$"), upper).when(value > 0, value.cast("string")).otherwise(upper)


def part_number(title: Column) -> Column:
    """Number in ``Part <label>``; empty when the title has none."""
    label = F.regexp_extract(clean_title(title), r"(?i)\bPart\s+([IVX]+|\d+)\b", 1)
    return F.when(label == "", F.lit("")).otherwise(label_number(label))


def is_cloze_title(title: Column) -> Column:
    return F.lower(clean_title(title)).rlike("cloze|完形|完型")


def is_reading_title(title: Column) -> Column:
    return F.lower(clean_title(title)).rlike("reading|阅读")


def is_blank_label(stem: Column) -> Column:
    return strip(F.coalesce(stem, F.lit(""))).rlike(r"(?i)^(?:blank|空)\s*\d+$")


def is_range_number(number: Column) -> Column:
    return strip(F.coalesce(number, F.lit(""))).rlike(r"^\d+\s*[-~—–]\s*\d+$")


def _is_furniture(stripped: Column) -> Column:
    rule = F.lit(False)
    for pattern in FURNITURE_LINES:
        rule = rule | stripped.rlike(pattern)
    return rule


def strip_page_artifacts(text: Column) -> Column:
    """Drop page furniture lines; blank lines stay, but never more than one in a row."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\R\z", ""), r"\R")
    kept = F.filter(lines, lambda line: ~_is_furniture(strip(line)))
    trimmed = F.transform(kept, lambda line: F.regexp_replace(line, r"(?U)\s+$", ""))
    return F.regexp_replace(F.array_join(trimmed, "\n"), r"\n{3,}", "\n\n")


def clean_inline(text: Column) -> Column:
    return squeeze(strip_page_artifacts(text))


def clean_paragraphs(text: Column) -> Column:
    paragraphs = F.transform(F.split(strip_page_artifacts(text), r"\n\s*\n"), squeeze)
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")


def clean_lines(text: Column) -> Column:
    lines = F.transform(
        F.split(strip_page_artifacts(text), "\n"),
        lambda line: strip(F.regexp_replace(line, r"[ \t]+", " ")),
    )
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def join_parts(*parts: Column) -> Column:
    """Non-blank parts, trimmed, joined by a blank line."""
    return F.concat_ws("\n\n", *[blank_to_null(strip(p)) for p in parts])


def normalize_exam_text(text: Column) -> Column:
    lowered = F.replace(F.lower(text), F.lit("’"), F.lit("'"))
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9']+", " "))
