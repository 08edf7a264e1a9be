"""Operators of a training-data pipeline: dedup, quality, language, secrets, tokens, mixing.

One module per operator (``opN_*.py``); ``queries.py`` registers one thin
query per operator.  Nothing outside this package imports it.
"""
