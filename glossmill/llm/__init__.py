"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; `queries` holds the thin contract queries over them.
"""
