"""Training-data operators: deduplication, decontamination, extraction, mixing, tokenised output.

Nothing else in the library imports this subpackage. Each operator is a
function over DataFrames with its own general interface; ``queries.py`` holds
the thin registered queries.
"""
