"""Subpackage of recordloom."""
