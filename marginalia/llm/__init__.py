"""Training-data operators: decontamination, near duplicates, extraction, scoring and mixing.

Nothing outside this subpackage imports it.
"""
