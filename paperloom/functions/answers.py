"""Canonical answers and exact scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

# Question types with a key that can be compared.
OBJECTIVE_TYPES = ["single_choice", "multiple_choice", "true_false"]


def has_answer(text: Column) -> Column:
    return F.coalesce(strip(text) != "", F.lit(False))


def has_answer_list(values: Column) -> Column:
    return F.coalesce(F.exists(values, lambda v: has_answer(v)), F.lit(False))


def normalize_parts(parts: Column) -> Column:
    upper = F.transform(F.filter(parts, has_answer), lambda p: F.upper(strip(p)))
    return F.array_sort(F.coalesce(upper, F.array().cast("array<string>")))


def normalize_answer(text: Column) -> Column:
    """Sorted upper-case parts of an answer text; one word of letters is split into letters."""
    trimmed = strip(F.coalesce(text, F.lit("")))
    letters = trimmed.rlike("^[A-Za-z]{2,}$")
    parts = F.when(letters, F.split(trimmed, "(?<=.)(?=.)")).otherwise(
        F.split(trimmed, r"(?U)[,，;；\s]+")
    )
    return normalize_parts(parts)


def money(value: Column) -> Column:
    """Exact decimal for scores; halves round up."""
    return F.round(value.cast("decimal(20,8)"), 2).cast("decimal(12,2)")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Exact quotient rounded to two places; 0 when there is nothing to divide by."""
    quotient = numerator.cast("decimal(18,6)") / F.when(denominator != 0, denominator).cast("decimal(18,6)")
    return F.coalesce(F.round(quotient, 2), F.lit(0)).cast("decimal(12,2)")
