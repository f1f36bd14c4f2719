"""Readers, writers and the preparation of question sets and tables."""
