"""Training-data operators: decontamination, filtering, de-duplication, extraction, redaction, packing and formatting.

Self-contained: nothing outside this subpackage imports it.
"""
