"""Training-data operators: sharding, extraction, decontamination, de-duplication,
token counting, quality rules, language-model scoring and packing.

Nothing outside this subpackage imports it.
"""
