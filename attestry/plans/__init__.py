"""Queries over the test tables."""

from . import more, queries  # noqa: F401  the first adds to the second
