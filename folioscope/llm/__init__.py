"""Operators for preparing language-model training corpora at cluster scale.

Nothing outside this subpackage imports it.  Each module holds one operator with a
DataFrame-in, DataFrame-out interface; ``queries`` registers the query forms.
"""
