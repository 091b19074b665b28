"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the registered queries are in :mod:`tapeweave.llm.queries`.
"""
