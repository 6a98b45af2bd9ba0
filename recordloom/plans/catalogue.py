"""Imports every module that registers queries."""

from recordloom.plans import corpus, files, limits, pages, records, relational, runs, state  # noqa: F401
