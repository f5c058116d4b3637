"""Operators of a training-data pipeline: language, licences, leaks, toxicity, quality,
personal data, near copies, mixing, token counts and page text.

Nothing outside this package imports it.
"""
