"""Training-data operators: dedup, scoring, packing, extraction, decontamination.

Nothing outside this subpackage imports it.
"""
