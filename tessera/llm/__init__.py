"""Training-data operators: formatting, near-duplicates, decontamination, scoring, mixing.

Nothing outside this subpackage imports it.
"""
