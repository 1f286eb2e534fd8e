"""Imports every query module, which registers its queries."""

from checks import queries_more, queries_reports, queries_rows, queries_stats  # noqa: F401
from checks.fixtures import ORACLE, QUERIES  # noqa: F401
