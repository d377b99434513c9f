"""Operators for preparing language-model training data.

Nothing outside this folder imports it; the folder can be deleted without
touching the rest of the library.
"""
