"""Operators for large text corpora: quality, language, mixing, duplicates, personal data, toxicity,
language-model scores and packing. Nothing outside this package imports it.
"""
