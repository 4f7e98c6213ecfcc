"""Operators for training-data pipelines over a table of documents (doc_id, text, lang, source, n_chars).

Every operator takes a DataFrame and returns one. Common to all: a null text counts as empty, a null
doc_id is an id of its own that sorts first, rows that repeat are rows of their own, an empty table
gives an empty result, and columns beyond the ones named are left alone.
"""
