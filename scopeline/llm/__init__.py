"""Training-data operators: quality, deduplication, decontamination, tokenising and scoring of text.

Nothing else in the package imports this subpackage. ``queries`` holds the thin
queries over the operators and ``oracles`` their SQL.
"""
