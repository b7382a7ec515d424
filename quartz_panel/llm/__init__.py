"""Operators for preparing language-model training text at corpus scale.

Nothing outside this folder imports it.  Every operator takes a DataFrame with the columns
``doc_id`` and ``text`` (others are carried or ignored, as each docstring says) and returns one.
"""
