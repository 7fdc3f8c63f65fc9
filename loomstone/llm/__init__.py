"""Operators of a training-data pipeline: fingerprints, language, media, deduplication, scoring, packing, tokens.

Nothing outside this subpackage imports it, so that it can be left out whole.
"""
