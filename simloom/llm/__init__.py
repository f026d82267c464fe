"""Operators of a training-data pipeline: scoring, deduplication, packing, encoding, extraction, archives.

Nothing outside this package imports it; ``queries`` registers one query per operator.

Common rules: tables may carry any further columns, also ones whose names clash with result
columns (only the named input columns are read); a null text counts as empty; repeated rows and
null ids are rows like any others; an empty table gives an empty result.
"""
