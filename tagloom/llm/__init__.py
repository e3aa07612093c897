"""Operators for preparing training text, one module each, and their registered queries.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
