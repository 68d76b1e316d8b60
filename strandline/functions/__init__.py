"""Strandline functions."""
