"""Training-data operators: archives, formatting, mixing, dedup, packing, filtering and scoring.

Nothing outside this subpackage imports it.
"""
