"""Operators for preparing language-model training data.

One module per operator; ``queries.py`` registers the thin ``opN_*`` queries.
Nothing else in the library imports this subpackage.
"""
