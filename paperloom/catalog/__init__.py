"""All registered queries."""

from . import coverage, flatten, grading, ledger, library, pages, plans, quality, review, scoring, sources, streams  # noqa: F401
from .registry import oracle_sql, queries  # noqa: F401
