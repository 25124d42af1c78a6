"""Training-data operators: tokenising, archives, deduplication, filtering and scoring.

Nothing outside this subpackage imports it. ``queries`` registers one query per operator.
"""
