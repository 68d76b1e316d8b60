"""Strandline operators."""
