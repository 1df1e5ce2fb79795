"""Operators of a training-data pipeline over a table ``documents(doc_id, text, lang, source, ...)``."""
