"""Strandline sources."""
