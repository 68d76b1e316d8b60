"""Imports every module that registers queries."""

from strandline.plans import degree_queries, form_queries, misc_queries, text_queries, walk_queries  # noqa: F401
